"""Content normalization on Spark: tables of captured bytes in, one normalized document table out."""

__version__ = "0.1.0"
