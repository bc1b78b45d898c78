"""Index build, lookups, and the registered queries."""
