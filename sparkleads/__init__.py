"""Outlier-lead analytics on Spark."""
