"""Column expressions: every function takes and returns Spark columns, nothing runs in Python per row."""
