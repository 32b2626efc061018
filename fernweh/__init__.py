"""fernweh: a PySpark-native search, retrieval and corpus-processing engine."""
