"""Inspection analytics on PySpark."""
