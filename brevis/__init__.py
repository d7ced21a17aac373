"""A Spark-native engine for text compression and code-length analytics."""
