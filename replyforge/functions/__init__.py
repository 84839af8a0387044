"""Column expressions: text, numbers, seeded hash order, fixed value packs."""
