"""Similarity search, recommendation and analytics on tables of points, on Spark."""

from nearfield.session import ship_package

__all__ = ["ship_package"]

ship_package()
