"""Spark-native analytics for irregularly sampled ecological time series."""
