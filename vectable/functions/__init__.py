"""Column expressions and per-batch numeric helpers."""
