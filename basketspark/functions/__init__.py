"""Column expressions: parsing, text, gates and similarity."""
