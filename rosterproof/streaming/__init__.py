"""Structured Streaming: incoming submissions and API events."""
