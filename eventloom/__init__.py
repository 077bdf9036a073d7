"""Event timelines on Spark: event tables in, token timelines and reports out."""

__version__ = "0.1.0"
