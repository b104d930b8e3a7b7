"""Queries that run the operators on the given tables, each next to its SQL twin."""

from importlib import import_module

MODULES = ["relational", "aggregates", "scalars", "sources", "pages", "mentions", "contexts",
           "matching", "sampling", "graphs", "prompts", "vectors", "streams"]



def load() -> None:
    for name in MODULES:
        import_module(f"docattr.catalog.{name}")
