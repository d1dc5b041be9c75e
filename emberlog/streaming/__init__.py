"""Structured Streaming jobs: continuous ingestion, live counts and the live tail."""
