"""Readers of document collections and logs."""
