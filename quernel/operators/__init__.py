"""Retrieval operators over DataFrames: chunks, links, graph, vectors, full text, fusion."""
