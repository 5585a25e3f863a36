"""Streaming of the siltstone engine."""
