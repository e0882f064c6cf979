"""Sources of the evidence analytics engine."""
