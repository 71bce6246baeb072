"""Functions of the message engine."""
