"""scantling: a PySpark-native engine for expensive-label analytics over tiled data."""
