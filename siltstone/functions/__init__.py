"""Functions of the siltstone engine."""
