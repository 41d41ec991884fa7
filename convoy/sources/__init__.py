"""Readers and writers."""
from convoy.sources.tables import shared_dir, table

__all__ = ["shared_dir", "table"]
