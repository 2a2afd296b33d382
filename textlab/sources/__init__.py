"""Readers, writers and saved classifiers."""
