"""How a query and its oracle are entered into a catalogue."""

from __future__ import annotations

from collections.abc import Callable


def register(catalogue: dict, sql: str | None = None) -> Callable:
    """Decorator: enter ``fn(spark, sf_dir)`` under its name, with its oracle SQL if there is one."""
    def add(fn: Callable) -> Callable:
        catalogue[fn.__name__] = (fn, sql)
        return fn

    return add
