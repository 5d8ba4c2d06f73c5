"""Whole passes over a corpus, built of the operators."""
