"""A Spark-native engine for document analytics and ranked retrieval."""
