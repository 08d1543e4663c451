"""Streams: deduplication, late versions, fetch states."""
