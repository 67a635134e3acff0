"""A PySpark-native query and retrieval engine for notes and other semi-structured records."""
