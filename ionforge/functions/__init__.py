"""Column expressions of the domain."""
