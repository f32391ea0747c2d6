"""Dialogue-corpus analytics and training-data operators on PySpark."""
