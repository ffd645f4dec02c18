"""Elementwise functions as columns."""
