"""Functions of netquarry."""
