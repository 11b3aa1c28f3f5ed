"""evispark: a Spark-first analytics engine for literature evidence."""

__version__ = "0.1.0"
