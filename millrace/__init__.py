"""Corpus analytics on Spark: data preparation and audit as DataFrame queries."""

__version__ = "0.1.0"
