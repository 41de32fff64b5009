"""Readers, writers and user splits."""
