"""Streaming of the evaluation library."""
