"""Operators on tensors and graphs."""
