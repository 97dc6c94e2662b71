"""docscreen: screening labelled text corpora with PySpark DataFrames."""

__version__ = "0.1.0"
