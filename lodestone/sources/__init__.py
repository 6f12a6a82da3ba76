"""Readers and writers of documents, cases, runs, feedback logs and caches."""
