"""Temporal fact analytics on Spark."""
