"""Structured Streaming forms of the daily counts, online features and scoring."""
