"""Plans of the sequence-analytics engine."""
