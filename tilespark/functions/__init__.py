"""Scalar functions on columns: tile addresses, geography, archive facts, request paths."""
