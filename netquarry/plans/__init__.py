"""Plans of netquarry."""
