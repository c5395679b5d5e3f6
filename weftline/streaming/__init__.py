"""Streams of events, kept as state by key."""
