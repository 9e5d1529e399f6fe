"""Retrieval analytics over code and text, as DataFrame operators on Spark."""
