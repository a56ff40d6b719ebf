"""Spark-native analytics over AI-assistant usage telemetry."""
