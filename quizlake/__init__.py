"""Spark-native analytics for versioned, verified question banks."""
