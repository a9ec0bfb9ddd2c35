"""Inkwell: a PySpark-native analytics engine for handwriting-screening tables."""
