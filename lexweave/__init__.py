"""lexweave: a Spark-native engine for dated, hierarchical, cross-referenced text corpora."""

__version__ = "0.1.0"
