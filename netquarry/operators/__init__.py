"""Operators of netquarry."""
