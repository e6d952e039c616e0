"""Readers, writers and read views."""
