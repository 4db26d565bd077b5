"""functions of tidegate."""
