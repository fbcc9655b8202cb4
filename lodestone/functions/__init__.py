"""Column expressions: text normalization and pair similarities."""
