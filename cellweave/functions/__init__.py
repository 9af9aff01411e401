"""Column functions: everything here is a Catalyst expression."""
