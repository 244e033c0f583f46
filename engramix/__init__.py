"""A PySpark-native engine for conversational memory: ingestion, retrieval, graph traversal and evaluation analytics."""
