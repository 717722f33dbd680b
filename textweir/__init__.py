"""Textweir: text-overlap, provenance and training-data analytics on Spark."""
