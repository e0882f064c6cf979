"""Plans of the evidence analytics engine."""
