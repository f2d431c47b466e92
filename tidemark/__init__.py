"""tidemark: a Spark-native engine for bitemporal claims, change feeds and retrieval."""
