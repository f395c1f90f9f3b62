"""Readers, incremental ingestion, sinks and the shared work folder."""
