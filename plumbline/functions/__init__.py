"""Column expressions; none of them starts a Python worker."""
