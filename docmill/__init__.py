"""docmill: a PySpark-native document-processing engine."""
