"""Structured Streaming jobs (view history, basket feed)."""
