"""Structured Streaming forms of the tracker, saved-search alerts and incremental consolidation."""
