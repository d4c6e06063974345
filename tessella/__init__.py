"""Tessella: finite-palette grid patterns and evidence analytics as Spark DataFrame plans."""
