"""Tideline: point-in-time analytics on Spark."""
