"""Streams into and out of tensors."""
