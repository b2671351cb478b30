"""Stateful ingestion on Structured Streaming, each with a batch twin."""
