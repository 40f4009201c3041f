"""Column functions: text, numbers and packed readings."""
