"""Functions of the evidence analytics engine."""
