"""netquarry: network-flow analytics written as Spark DataFrame programs."""
