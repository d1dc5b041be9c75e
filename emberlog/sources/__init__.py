"""Readers and writers: request envelopes and the day-partitioned log store."""
