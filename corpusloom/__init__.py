"""Corpus intelligence on Spark: fragments, relation graphs, retrieval and roll-ups over code and documents."""
