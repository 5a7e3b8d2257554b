"""Loads the modules that register the queries of this subpackage."""

from importlib import import_module

from .common import ORACLES, QUERIES

MODULES = ("sharding", "bpe", "jaccard", "decontam", "quality", "pii", "suffix", "fingerprint", "extraction", "warc", "token_links", "neighbour_graph", "targeting")

for _name in MODULES:
    import_module(f"{__package__}.{_name}")

__all__ = ["ORACLES", "QUERIES"]
