"""Readers, writers and the retail view over the sample tables."""
