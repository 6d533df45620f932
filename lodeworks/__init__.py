"""A PySpark-native engine for knowledge about source code and text."""
