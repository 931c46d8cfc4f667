"""Column-expression builders; everything stays inside Catalyst."""
