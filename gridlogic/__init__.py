"""A Spark-native engine for two-dimensional layouts: parse, infer, score, aggregate, generate."""
