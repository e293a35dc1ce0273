"""Retrieval and change analytics as PySpark DataFrame operators."""
