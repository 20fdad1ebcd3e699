"""Column functions over text and paths."""
