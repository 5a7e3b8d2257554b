"""The registered queries, one module per family of operators."""

from importlib import import_module

MODULES = ("lexical", "structure", "search", "text", "alignment", "validation", "reading", "sources")


def load() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
