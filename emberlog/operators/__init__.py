"""Operators on log tables; each takes and returns DataFrames."""
