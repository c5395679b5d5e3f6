"""Readers, writers and table mappings."""
