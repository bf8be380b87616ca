"""Sparse tensors and graphs as DataFrames."""
