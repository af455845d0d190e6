"""Structured Streaming forms of the gaze operators."""
