"""hexsupport: a PySpark-native engine for hexagonal-grid supports."""
