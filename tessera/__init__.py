"""Corpus analytics on Spark: catalog, similarity, graph and streaming operators."""
