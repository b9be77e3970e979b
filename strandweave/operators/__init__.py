"""Operators of the sequence-analytics engine."""
