"""Streaming forms of batch merges, by the same functions."""
