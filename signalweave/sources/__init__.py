"""Readers, the source registry and tables."""
