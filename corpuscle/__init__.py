"""A PySpark-native document-retrieval and corpus-processing engine."""
