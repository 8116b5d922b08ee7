"""A PySpark-native engine for conversation records."""
