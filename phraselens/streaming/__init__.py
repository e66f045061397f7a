"""Structured Streaming forms of phrase counting and text classification."""
