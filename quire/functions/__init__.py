"""Column expressions: dates, strings, numbers, positions in books."""
