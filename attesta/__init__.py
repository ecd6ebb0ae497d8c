"""attesta: provenance-preserving evidence analytics on Apache Spark."""

__version__ = "0.1.0"
