"""Queries on the driver's tables, each with the SQL that must give the same result."""

from __future__ import annotations

from importlib import import_module

MODULES = [
    "scans", "profiling", "detection", "aggregation", "cleaning", "scoring", "fabrication",
    "repairing", "domain", "nesting",
]


def all_queries() -> dict:
    found: dict = {}
    for name in MODULES:
        for key, item in import_module(f"catalog.{name}").QUERIES.items():
            if key in found:
                raise ValueError(f"query defined twice: {key}")
            found[key] = item
    return found
