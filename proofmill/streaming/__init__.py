"""Streaming of the evidence analytics engine."""
