"""Spark-native construction, querying and auditing of embedding maps."""
