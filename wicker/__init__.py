"""wicker: a Spark-native engine for code-and-text graphs."""
