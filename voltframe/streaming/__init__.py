"""Recordings that come in chunks."""
