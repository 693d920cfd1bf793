"""Regression fits on Spark aggregates."""
