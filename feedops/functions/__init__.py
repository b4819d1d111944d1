"""Column expressions: no Python code runs per row in any of them."""
