"""Column functions and small numeric kernels."""
