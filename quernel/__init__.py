"""Hybrid retrieval over notes, and corpus preparation, on Spark."""
