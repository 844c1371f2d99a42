"""Structured Streaming: incremental upkeep of the index."""
