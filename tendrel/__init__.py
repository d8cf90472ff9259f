"""tendrel: document evidence and training-data operators as PySpark DataFrame plans."""

__version__ = "0.1.0"
