"""Lamina: layered-corpus retrieval, audit and evaluation on PySpark."""
