"""Operators of the evidence analytics engine."""
