"""Readers with explicit schemas, and adapters of the test tables."""
