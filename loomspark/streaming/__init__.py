"""Streams: models fed incrementally, an extension."""
