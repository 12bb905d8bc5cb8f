"""Incremental graph maintenance with Structured Streaming."""
