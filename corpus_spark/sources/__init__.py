"""Readers, writers and path helpers."""
