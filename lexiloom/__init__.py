"""Corpus analytics on Spark: ingest, alignment, lexical analytics and tolerant search."""
