"""Structured Streaming: event features, counters, joins and sinks."""
