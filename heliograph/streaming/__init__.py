"""Structured Streaming forms of the scan."""
