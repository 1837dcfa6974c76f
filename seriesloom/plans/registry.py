"""Query registry and the shared CTEs of the equivalent SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
CTES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may refer to the shared CTEs by name."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"Duplicate query name: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_ctes(sql)
        return fn

    return wrap


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


def _uses(sql: str) -> list[str]:
    words = set(re.findall(r"[a-z_][a-z0-9_]*", sql))
    return [name for name in CTES if name in words]


def with_ctes(sql: str) -> str:
    """Prefix the statement with the CTEs it needs, in registration order."""
    needed: set[str] = set()
    todo = _uses(sql)
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo += _uses(CTES[name])
    body = sql.strip()
    if not needed:
        return body
    parts = [f"{name} AS (\n{CTES[name]}\n)" for name in CTES if name in needed]
    own = re.match(r"(?is)with\s+(recursive\s+)?", body)
    word = "WITH "
    if own:
        word = "WITH RECURSIVE " if own.group(1) else "WITH "
        return word + ",\n".join(parts) + ",\n" + body[own.end():]
    return word + ",\n".join(parts) + "\n" + body
