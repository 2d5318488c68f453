"""Inputs derived from the driver's tables, and the catalogue of queries over them."""
