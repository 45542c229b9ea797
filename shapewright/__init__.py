"""Shapewright: profile analytics and training-data operators on Spark."""
