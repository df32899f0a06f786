"""Column-level rules: every function returns a Column and runs inside Spark's own expressions."""
