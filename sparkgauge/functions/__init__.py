"""Column expressions: names, patterns, missing values, hashes and exact order statistics."""
