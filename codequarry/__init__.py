"""A PySpark-native code-analytics engine."""
