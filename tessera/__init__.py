"""tessera: a PySpark-native engine for repository intelligence and debugging data."""

__all__ = ["session"]
