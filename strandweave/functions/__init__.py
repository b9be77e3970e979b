"""Functions of the sequence-analytics engine."""
