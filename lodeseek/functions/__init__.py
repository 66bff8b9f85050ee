"""Column functions; built-in expressions throughout."""
