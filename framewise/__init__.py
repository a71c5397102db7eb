"""Spark-native analytics for frame-indexed, multi-entity tracking data."""
