"""Column expressions: text, vectors, money, sizes."""
