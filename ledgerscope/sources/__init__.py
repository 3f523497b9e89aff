"""Readers, writers and the mapping from the bench tables."""
