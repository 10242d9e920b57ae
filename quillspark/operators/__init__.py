"""Relational, retrieval, graph, version, quality and evaluation operators."""
