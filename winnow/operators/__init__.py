"""Grouping, digests, plans and ledgers over inventories."""
