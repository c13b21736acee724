"""Ordered-log analytics on Spark: ordering, frontiers, state replay and trace statistics as DataFrame transforms."""
