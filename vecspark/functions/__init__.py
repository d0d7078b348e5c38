"""Column expressions and kernels over dense vectors."""
