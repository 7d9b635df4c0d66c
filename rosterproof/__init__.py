"""Registry audit and document verification as Spark DataFrame jobs."""

__version__ = "0.1.0"
