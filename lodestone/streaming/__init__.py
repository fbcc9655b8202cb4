"""Linkage of records that arrive over time."""
