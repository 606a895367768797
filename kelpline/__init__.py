"""kelpline: a PySpark-native retrieval, document and market-data engine."""
