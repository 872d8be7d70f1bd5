"""Approximate range aggregates and training-data operators on Spark."""
