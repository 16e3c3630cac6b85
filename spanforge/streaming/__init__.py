"""Structured Streaming: ordered micro-batches and keyed state."""
