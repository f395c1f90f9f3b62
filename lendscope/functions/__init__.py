"""Column expressions, fixed values and p-value helpers."""
