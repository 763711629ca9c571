"""Operators for training-data pipelines. Nothing else in netquarry imports this subpackage."""
