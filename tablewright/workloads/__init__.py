"""Registered queries by area."""

from importlib import import_module

AREAS = ("scans", "profiling", "association", "quality", "features", "ranking", "modelling")


def load() -> None:
    """Imports all areas, which registers their queries."""
    for area in AREAS:
        import_module(f"{__name__}.{area}")
