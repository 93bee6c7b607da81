"""Granule search, spatial partitioning and search-log analytics on Spark tables."""

__version__ = "0.1.0"
