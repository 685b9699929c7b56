"""Table profiling, leakage checks and model building as plain Spark jobs."""
