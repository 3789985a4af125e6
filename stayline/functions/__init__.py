"""Column expressions: parsing, time arithmetic, scores and fixed-length sequences."""
