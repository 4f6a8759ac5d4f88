"""Column expressions: no function here takes or returns a DataFrame."""
