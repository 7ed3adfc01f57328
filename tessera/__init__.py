"""Tessera: a PySpark-native engine for annotation, geometry and evaluation analytics."""

__version__ = "0.1.0"
