"""Column expressions: parsing, coercion, labels and derived fields."""
