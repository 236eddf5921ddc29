"""Column functions: text, tags."""
