"""Column expressions: seeded draws, text, dates and numbers."""
