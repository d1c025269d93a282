"""Column expressions and window expressions."""
