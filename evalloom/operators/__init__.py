"""Operators of the evaluation library."""
