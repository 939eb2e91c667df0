"""Registered query plans."""

from importlib import import_module

MODULES = ("bars", "rolling", "indicator", "table", "aggregate", "micro", "risk", "drift", "quality", "stream", "store")


def load_all() -> None:
    for name in MODULES:
        import_module(f"quotemill.plans.{name}_queries")
