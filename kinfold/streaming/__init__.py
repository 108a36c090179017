"""Linkage of rows that keep arriving."""
