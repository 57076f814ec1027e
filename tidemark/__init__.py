"""tidemark: a PySpark-native engine for versioned tables."""
