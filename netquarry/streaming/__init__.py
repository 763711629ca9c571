"""Streaming of netquarry."""
