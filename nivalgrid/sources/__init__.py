"""Readers, sinks and input checks."""
