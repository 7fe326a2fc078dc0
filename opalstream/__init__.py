"""A PySpark-native analytics engine for oracle-event streams."""
