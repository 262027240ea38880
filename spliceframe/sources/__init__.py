"""Readers of the project's files and tables."""
