"""Column functions: no shuffles, no collecting."""
