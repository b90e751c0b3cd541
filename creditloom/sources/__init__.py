"""Readers, declared schemas, sinks and the derived sample tables."""
