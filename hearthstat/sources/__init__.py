"""Readers, writers and stored intermediate tables."""
