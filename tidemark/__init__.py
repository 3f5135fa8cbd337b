"""Event and fiscal-series analytics on Spark."""
