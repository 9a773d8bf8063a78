"""A PySpark-native analytics library."""
