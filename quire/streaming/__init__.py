"""Streams of documents and of events; an addition to the batch engine."""
