"""A PySpark-native analytics engine for a multi-modal media catalogue."""
