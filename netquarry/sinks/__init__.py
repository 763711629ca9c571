"""Sinks of netquarry."""
