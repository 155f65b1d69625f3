"""Named queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from outlane.sources.tables import Tables

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Shared SQL fragments: name -> (names it needs, SELECT text).
FRAGMENTS: dict[str, tuple[tuple[str, ...], str]] = {}


def fragment(name: str, needs: str, text: str) -> None:
    FRAGMENTS[name] = (tuple(needs.split()), text)


def with_fragments(needs: str, body: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for need in FRAGMENTS[name][0]:
            visit(need)
        ordered.append(name)

    for name in needs.split():
        visit(name)
    head = ",\n".join(f"{n} AS ({FRAGMENTS[n][1]})" for n in ordered)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}" if head else body
    return f"WITH {head}\n{body}" if head else body


def query(name: str, needs: str = "", sql: str | None = None):
    """Register a query; without ``sql`` the rows are checked by tests only."""
    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_fragments(needs, sql)
        return fn
    return register


def r6(expr: str) -> str:
    rounded = f"round(CAST({expr} AS DOUBLE) + 1e-10, 6)"
    return f"(CASE WHEN {rounded} = 0 THEN 0.0 ELSE {rounded} END)"
