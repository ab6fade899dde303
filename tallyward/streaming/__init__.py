"""Structured Streaming twins of the batch roll-ups."""
