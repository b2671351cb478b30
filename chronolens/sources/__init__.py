"""Readers, sinks and the shared working area."""
