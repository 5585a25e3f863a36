"""Operators of the siltstone engine."""
