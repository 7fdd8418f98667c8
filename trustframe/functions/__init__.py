"""Column functions: labels, keyed hashes, scalars and vector arithmetic."""
