"""Operators of the message engine."""
