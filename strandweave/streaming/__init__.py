"""Streaming of the sequence-analytics engine."""
