"""Readers: driver tables, fixture views, JSON posting ingest."""
