"""Column expressions: cells, record codec, command language, key order."""
