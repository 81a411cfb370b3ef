"""Structured Streaming counterparts of incremental work."""
