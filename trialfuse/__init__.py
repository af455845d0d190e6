"""Multimodal experiment analytics as PySpark DataFrame plans."""
