"""Structured Streaming: change feeds folded into an index."""
