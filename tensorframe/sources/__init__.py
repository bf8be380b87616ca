"""Constructors, readers and writers of tensors, and shared storage."""
