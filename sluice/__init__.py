"""A Spark-native engine that finds, scores and protects sensitive data in text."""
