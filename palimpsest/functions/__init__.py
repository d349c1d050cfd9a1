"""Expressions over keys and values, and what stands for bounds and Bloom filters."""
