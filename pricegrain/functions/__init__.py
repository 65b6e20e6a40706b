"""Column functions: text, units and presentation."""
