"""Tensors, expressions, sparse matrices and kernels."""
