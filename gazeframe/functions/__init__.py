"""Column functions: labels, numbers, geometry, statistics."""
