"""Riverglass: telemetry, detection and trajectory analytics on Spark."""
