"""Column builders: every formula is a native Spark expression (no UDF)."""
