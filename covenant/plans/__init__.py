"""Queries by part of the inventory."""
