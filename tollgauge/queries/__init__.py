"""Registered queries and their check SQL."""

from __future__ import annotations

import importlib

MODULES = ["usage", "ranking", "history", "text", "catalog", "quality", "orders"]


def load():
    """(queries, check SQL) of all query modules."""
    for m in MODULES:
        importlib.import_module(f"tollgauge.queries.{m}")
    from tollgauge.queries.registry import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
