"""Structured Streaming jobs over change feeds."""
