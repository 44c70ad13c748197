"""Typed ingest, table layout, read and publish."""
