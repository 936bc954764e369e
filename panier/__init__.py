"""Basket analytics on PySpark."""
