"""Column expressions and Python table functions over source text and endpoints."""
