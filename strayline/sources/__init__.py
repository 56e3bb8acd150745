"""Readers, writers and generated tables."""
