"""Column expressions: text, numbers, cells, URLs, display text, parameters."""
