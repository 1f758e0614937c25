"""Column -> Column building blocks (all built-in expressions, no Python UDF)."""
