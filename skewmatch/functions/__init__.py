"""Column functions: blocking keys, text shaping, similarity."""
