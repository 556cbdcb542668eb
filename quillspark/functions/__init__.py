"""Column functions: each takes and returns Columns, so Catalyst sees through them."""
