"""Beaconry: device-telemetry analytics on PySpark DataFrames."""
