"""Structured Streaming: each uploaded file is ingested exactly once."""
