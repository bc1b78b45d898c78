"""Cross-reference of versioned source trees, as Spark DataFrame jobs."""
