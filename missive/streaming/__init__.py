"""Streaming of the message engine."""
