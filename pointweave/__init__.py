"""Point-pattern analytics for located incidents, written as Spark DataFrame operators."""

__version__ = "0.1.0"
