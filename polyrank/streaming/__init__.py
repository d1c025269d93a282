"""Incremental upkeep of group results."""
