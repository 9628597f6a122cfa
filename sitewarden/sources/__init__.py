"""Readers, derived input views and sinks."""
