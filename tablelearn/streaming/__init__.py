"""Scoring and validation of arriving data with Structured Streaming."""
