"""Spark-native ingestion, search and summaries of structured application logs."""

from emberlog.session import configure
from emberlog.sources.store import LogStore

__all__ = ["LogStore", "configure"]
