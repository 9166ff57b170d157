"""Readers and ingest projections that produce the ``logs`` shape."""
