"""Column expressions: vectors, durations and paths."""
