"""Structured Streaming: scoring arriving texts and incremental fitting per micro-batch."""
