"""Kinfold: Spark-first code-provenance analytics."""
