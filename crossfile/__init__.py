"""A PySpark-native engine for whole-program code analytics."""
