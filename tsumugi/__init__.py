"""Tsumugi: a PySpark-native engine for building, cleaning and scoring text benchmarks."""

__version__ = "0.1.0"
