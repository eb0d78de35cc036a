"""Column expressions and the numpy kernel of the window model."""
