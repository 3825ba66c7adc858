"""kinloom: a PySpark-native engine for building and evaluating alignments between two knowledge graphs."""

__version__ = "0.1.0"
