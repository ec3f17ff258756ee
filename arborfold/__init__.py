"""A PySpark-native engine for relations of web documents."""
