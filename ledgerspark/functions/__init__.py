"""Column expressions: rounding, text fingerprints, prices, scaling."""
