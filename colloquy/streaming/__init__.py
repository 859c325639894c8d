"""Structured Streaming wrappers around the batch ingestion."""
