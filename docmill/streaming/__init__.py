"""Structured Streaming: change streams, event-time windows and messages."""
