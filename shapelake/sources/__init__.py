"""Readers, stores, and the bridge to the given tables."""
