"""Weighted-survey analytics and training-data operators on Spark."""
