"""PySpark-native provenance-graph analytics."""
