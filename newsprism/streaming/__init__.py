"""Structured Streaming: score articles as they land."""
