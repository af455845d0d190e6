"""Column expressions: coding rules, geometry, distribution functions."""
