"""Duplicate detection and cleanup planning on Spark."""
