"""Hybrid retrieval and corpus analytics as declarative Spark plans."""
