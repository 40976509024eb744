"""Spark-native workload cost analytics: usage, plan, source and estimation dataflows."""

__version__ = "0.1.0"
