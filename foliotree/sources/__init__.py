"""Reading files into the catalog, and writing and reading derived tables."""
