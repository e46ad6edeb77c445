"""A Spark-native engine for annotated text: documents are text plus typed features on byte ranges."""

__version__ = "0.1.0"
