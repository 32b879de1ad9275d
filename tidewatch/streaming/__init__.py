"""Structured Streaming forms of the scheduled jobs."""
