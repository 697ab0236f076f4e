"""Abundance-threshold analytics on Spark."""
