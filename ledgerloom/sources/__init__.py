"""Readers, writers and the mapping of the driver tables."""
