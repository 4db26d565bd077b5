"""operators of tidegate."""
