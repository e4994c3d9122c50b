"""Registry and the common table expressions the SQL counterparts share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orderpulse.functions.exprs import nudge

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; `sql` is the body that follows the common table expressions it names."""

    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def cte(name: str, sql: str) -> None:
    if name in CTES:
        raise ValueError(f"expression {name} is registered twice")
    CTES[name] = sql


def _names(sql: str) -> list[str]:
    words = set(re.findall(r"\b(?:from|join|in|,)\s*\(?\s*([a-z_0-9]+)\b", sql, flags=re.I))
    return [w for w in CTES if w in words]


def compose(body: str) -> str:
    """Prefix the body with the expressions it needs, dependencies first; a name that the body defines stays its own."""
    done: list[str] = []
    own = set(re.findall(r"\b([a-z_0-9]+)\s+AS\s+(?:MATERIALIZED\s+)?\(\s*(?:SELECT|WITH|FROM)\b", body, flags=re.I))

    def visit(name: str) -> None:
        if name in done:
            return
        for dep in _names(CTES[name]):
            if dep != name:
                visit(dep)
        done.append(name)

    for name in _names(body):
        if name not in own:
            visit(name)
    if not done:
        return body
    # Each expression is computed once: several of them are read many times further down.
    parts = ",\n".join(f"{n} AS MATERIALIZED (\n{CTES[n].strip()}\n)" for n in done)
    body = body.strip()
    if re.match(r"with\s", body, flags=re.I):
        return f"WITH {parts},\n{body[4:].strip()}"
    return f"WITH {parts}\n{body}"


def rnd(expr: str, digits: int = 8) -> str:
    """The rounding of `round_all` in SQL."""
    return f"round({expr} + {nudge(digits)!r}, {digits})"
