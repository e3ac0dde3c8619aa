"""Compressed streams, archives and images as Spark tables."""
