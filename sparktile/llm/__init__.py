"""Training-data operators over document, page and conversation tables.

Nothing outside this folder imports it; deleting it leaves the tensor and
sparse-matrix engine whole.
"""
