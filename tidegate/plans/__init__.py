"""plans of tidegate."""
