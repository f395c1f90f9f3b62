"""Structured Streaming versions of scoring, monitoring and ingestion."""
