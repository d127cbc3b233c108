"""A PySpark-native analytics engine for crowd-timed event data."""
