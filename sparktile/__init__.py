"""Distributed tensors, sparse linear algebra and nested solvers on Spark DataFrames."""
