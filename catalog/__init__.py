"""Registered queries."""

from __future__ import annotations

import importlib

_MODULES = ("sources", "events", "sequences", "texts", "vocabularies", "reports", "runs")


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"catalog.{name}")


def all_queries():
    from catalog.registry import QUERIES

    _load()
    return dict(QUERIES)


def all_oracles():
    from catalog.registry import ORACLES

    _load()
    return dict(ORACLES)
