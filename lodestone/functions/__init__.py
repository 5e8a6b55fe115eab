"""Column functions: text, vectors and dates."""
