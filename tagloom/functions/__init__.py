"""Column expressions: names, paths, text, version keys."""
