"""Device-fleet telemetry analytics on PySpark DataFrames."""
