"""Sources of the siltstone engine."""
