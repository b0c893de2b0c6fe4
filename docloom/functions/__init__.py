"""Column expressions: geometry and text; page images as arrays."""
