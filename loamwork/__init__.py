"""A Spark-native engine for retrieval over text knowledge bases."""
