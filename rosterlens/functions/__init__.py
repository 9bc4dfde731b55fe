"""Column-level functions: pure expressions, no joins, no actions."""
