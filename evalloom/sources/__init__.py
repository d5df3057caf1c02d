"""Sources of the evaluation library."""
