"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it; it may be removed as a whole.
"""
