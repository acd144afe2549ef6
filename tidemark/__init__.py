"""A PySpark-native time-series analytics engine."""
