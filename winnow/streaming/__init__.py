"""Inventories that arrive as streams."""
