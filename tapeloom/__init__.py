"""Point-in-time analytics for news and market data, on PySpark."""

__version__ = "0.1.0"
