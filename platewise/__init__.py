"""Screening analytics on Spark: DataFrame operators for plate-structured data."""

__version__ = "0.1.0"
