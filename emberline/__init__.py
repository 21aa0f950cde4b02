"""Emberline: incident analytics as Spark DataFrame plans."""
