"""Gridded climate analytics on Spark."""
