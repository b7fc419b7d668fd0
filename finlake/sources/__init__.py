"""Readers, table sinks and profiles."""
