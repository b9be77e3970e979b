"""Sequence analytics on Spark: strings are tables, k-mers are rows, every operator is a DataFrame plan."""
