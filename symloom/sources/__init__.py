"""Readers: tables of the graph, source files, hashes, lines."""
