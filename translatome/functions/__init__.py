"""Column expressions: coordinates, sequences and statistics."""
