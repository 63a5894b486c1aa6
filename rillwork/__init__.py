"""Distributed signal-to-prediction analytics as Spark DataFrame jobs."""
