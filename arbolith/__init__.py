"""Arbolith: Spark-native operators for trajectory trees, evaluations and chat data."""

__version__ = "0.1.0"
