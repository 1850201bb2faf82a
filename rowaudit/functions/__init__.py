"""Column expressions: canonical text, names and types."""
