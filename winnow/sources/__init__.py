"""Inventories from file trees and tables, and the listing sink."""
