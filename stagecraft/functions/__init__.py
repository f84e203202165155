"""Column functions (scalars, types, text) and user-defined functions."""
