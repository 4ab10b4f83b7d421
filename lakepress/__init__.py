"""Lakepress: text-compression and corpus analytics on Apache Spark."""

__version__ = "0.1.0"
