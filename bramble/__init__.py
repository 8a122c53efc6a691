"""A PySpark-native analytics engine: relational, temporal and streaming operators on the DataFrame API."""
