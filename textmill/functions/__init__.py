"""Column functions with Python-compatible text, integer and collection semantics."""
