"""Spark library for corpora of bills of materials."""

__version__ = "0.1.0"
