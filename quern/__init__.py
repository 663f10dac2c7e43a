"""Quern: a Spark-native engine for training-corpus preparation and training telemetry."""
