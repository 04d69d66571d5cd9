"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it; deleting the folder leaves the rest
of the library and its tests intact.
"""
