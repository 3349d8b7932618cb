"""Column functions: numbers, dates and text, all built from native expressions."""
