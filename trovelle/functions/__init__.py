"""Column builders and vectorised text kernels."""
