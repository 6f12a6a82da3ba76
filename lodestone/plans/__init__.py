"""Whole pipelines: answering questions, evaluating runs, collecting pages."""
