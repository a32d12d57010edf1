"""millrace: Spark-native curation of language-model training data."""

__version__ = "0.1.0"
