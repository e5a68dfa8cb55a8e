"""Readers, writers and the dataset store."""
