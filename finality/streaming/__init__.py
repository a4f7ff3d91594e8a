"""Structured Streaming form of the window policies."""
