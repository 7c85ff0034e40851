"""Column expressions: URLs, text, dates, pages, validation."""
