"""Registered queries: operators applied to the sales tables, each with the same result in SQL."""

from __future__ import annotations

from importlib import import_module

FAMILIES = (
    "rates",
    "cubes",
    "derivations",
    "quality",
    "sources",
    "drift",
    "splits",
    "metrics",
    "models",
    "reports",
)


def load() -> None:
    for family in FAMILIES:
        import_module(f"ratescope.plans.{family}")
