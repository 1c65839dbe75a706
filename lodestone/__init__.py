"""Dependency intelligence and analytics on Spark."""
