"""Retrieval, selection, feedback, evaluation and dashboard operators over DataFrames."""
