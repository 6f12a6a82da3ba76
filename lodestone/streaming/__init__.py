"""Feedback as a stream."""
