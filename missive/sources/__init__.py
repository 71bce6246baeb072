"""Sources of the message engine."""
