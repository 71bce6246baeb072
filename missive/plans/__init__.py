"""Plans of the message engine."""
