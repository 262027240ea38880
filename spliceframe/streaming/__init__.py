"""Streaming of spliceframe."""
