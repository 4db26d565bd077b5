"""streaming of tidegate."""
