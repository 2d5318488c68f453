"""Scalar functions: each takes names of columns and returns a Column made of built-in expressions."""
