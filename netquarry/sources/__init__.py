"""Sources of netquarry."""
