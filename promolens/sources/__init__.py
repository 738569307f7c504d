"""Readers, writers and the retail views over the provided tables."""
