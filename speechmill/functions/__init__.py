"""Column functions: text, distances, signals."""
