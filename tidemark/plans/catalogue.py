"""All registered queries with their oracles."""

from __future__ import annotations

import importlib

MODULES = ["patterns", "history", "graphs", "firings", "messages", "formats"]


def catalogue() -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(importlib.import_module(f"tidemark.plans.{name}").QUERIES)
    return out
