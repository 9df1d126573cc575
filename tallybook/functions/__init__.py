"""Column expressions: parsing, masking, banding, labels, n-grams."""
