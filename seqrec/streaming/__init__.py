"""Structured Streaming versions of the block and similarity operators."""
