"""Column functions: text, vectors, scalars."""
