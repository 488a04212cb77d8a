"""Streaming of the panel engine."""
