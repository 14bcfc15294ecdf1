"""Readers, caches and the derived bar tables."""
