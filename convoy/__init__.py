"""Convoy: set-at-a-time analytics over job traffic, on PySpark."""
