"""Reading and writing tables, documents and structures."""
