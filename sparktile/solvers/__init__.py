"""Nested iterative solvers and preconditioners."""
