"""Queries over the driver's tables, one for each operator."""

import importlib

MODULES = ("scans", "predicates", "joins", "aggregates", "sequences", "scalars", "geometry", "composites", "streams")


def load() -> None:
    """Import every module of queries, which registers them."""
    for name in MODULES:
        importlib.import_module(f"quirewise.plans.{name}")
