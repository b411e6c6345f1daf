"""gazelark: a Spark-native engine for looking things up in tables of named entities."""

__version__ = "0.1.0"
