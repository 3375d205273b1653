"""Operators over tables of (trace, sample index, value): each takes and returns DataFrames."""
