"""Column functions with IEEE-754 semantics."""
