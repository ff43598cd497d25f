"""Column functions over records, headers and HTTP messages."""
