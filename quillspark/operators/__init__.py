"""Relational operators: each takes and returns DataFrames, and its docstring names what it covers."""
