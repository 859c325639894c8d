"""How a query and its SQL are registered."""

from __future__ import annotations

from collections.abc import Callable


def registering(queries: dict[str, Callable], oracles: dict[str, str]) -> Callable:
    """A decorator: the function becomes a query of its name; ``sql``, after ``prelude``, is its SQL."""

    def query(sql: str | None = None, prelude: str = "") -> Callable:
        def add(f: Callable) -> Callable:
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = prelude + sql
            return f

        return add

    return query
