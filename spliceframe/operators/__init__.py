"""Operators of spliceframe."""
