"""Streaming forms: listing cycles by micro-batches, windowed events."""
