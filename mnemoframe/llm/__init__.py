"""Operators for large training corpora: each takes and returns DataFrames."""
