"""Parsing of einsum specs and planning of contractions; pure Python, no Spark."""
