"""Column functions on names, sequences and qualities."""
