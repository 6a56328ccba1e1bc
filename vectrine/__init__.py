"""Hybrid document search and document data processing on Spark."""
