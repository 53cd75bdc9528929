"""Spark-native analytics for moving-object tracks and gridded polar fields."""
