"""Column expressions and small grouped primitives."""
