"""Relational operators: top-k, graph joins, trees, snapshots."""
