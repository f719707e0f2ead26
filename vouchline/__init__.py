"""Grounded-corpus analytics as Spark plans."""
