"""A PySpark-native analytics engine; see README.md."""
