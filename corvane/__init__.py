"""corvane: a PySpark-native engine for document intelligence and graph-aware retrieval."""
