"""Column builders: text, JSON text and rounding, all on built-in expressions."""
