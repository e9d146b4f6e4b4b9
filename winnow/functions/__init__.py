"""Column functions over inventories."""
