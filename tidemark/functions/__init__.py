"""Column functions and distances."""
