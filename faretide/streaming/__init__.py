"""Incremental forms of ingest, alerting and windowed statistics."""
