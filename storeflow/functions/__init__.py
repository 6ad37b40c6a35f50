"""Column expressions: exact money, threshold bands, text repair, and
size-checked broadcasts."""
