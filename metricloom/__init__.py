"""Spark-native analytics for metric frames sent by many agents."""
