"""tessera: a PySpark-native engine for columnar table operations."""
