"""Entity-attribute corpus building, vote aggregation and evaluation on Spark."""

__version__ = "0.1.0"
