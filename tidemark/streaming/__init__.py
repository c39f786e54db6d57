"""Structured Streaming jobs: tick bars and online scoring."""
