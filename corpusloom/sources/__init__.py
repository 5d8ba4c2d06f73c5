"""Readers of source trees, documents and wiki pages, and the parsers that cut them into fragments."""
