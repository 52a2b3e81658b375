"""Structured Streaming: cooldown state, search on streams, frame sampling."""
