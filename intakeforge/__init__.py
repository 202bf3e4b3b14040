"""Governed-intake data processing on Spark: staging, profiling, mapping, drift, casts and upserts as DataFrame plans."""

__version__ = "0.1.0"
