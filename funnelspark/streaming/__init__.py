"""Structured Streaming forms of the main operators."""
