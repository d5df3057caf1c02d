"""Functions of the evaluation library."""
