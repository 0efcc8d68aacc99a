"""Calorway: heat-exposure and walk analytics as set-oriented PySpark jobs."""

__version__ = "0.1.0"
