"""Quarry: relational, graph, search and streaming operators over code and document corpora, on PySpark."""
