"""Marram: corpus retrieval and evaluation operators as PySpark plans."""
