"""Service-topology analytics on Spark."""
