"""Structured Streaming forms of the bar and position operators."""
