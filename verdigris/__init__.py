"""Verdigris: hybrid retrieval and text analytics as PySpark DataFrame operators."""
