"""Spark-native rolling-origin evaluation of panels of time series."""
