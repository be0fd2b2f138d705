"""Workload-driven search over entity relations, on Spark."""
