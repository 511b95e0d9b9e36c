"""Column expressions: calendar arithmetic, null handling, text, pseudo-random draws."""
