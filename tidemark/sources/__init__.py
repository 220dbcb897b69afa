"""Readers, writers and the versioned table that keyed upserts go to."""
