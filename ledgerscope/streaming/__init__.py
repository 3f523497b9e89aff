"""Structured Streaming forms of the windowed, deduplicating and stateful operators."""
