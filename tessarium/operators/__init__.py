"""Operators: search, links, duplicates, checks, events and lifecycle."""
