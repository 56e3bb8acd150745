"""Queries over the test tables, each with its SQL twin where one exists."""

from importlib import import_module

MODULES = ("sources", "columns", "outliers", "graphs", "sampling", "models", "fits")


def load() -> None:
    """Register every query."""
    for module in MODULES:
        import_module(f"strayline.catalog.{module}")
