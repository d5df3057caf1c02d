"""Plans of the evaluation library."""
