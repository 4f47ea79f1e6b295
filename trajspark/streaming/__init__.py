"""Structured Streaming: datasets that grow."""
