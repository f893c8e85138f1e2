"""Registration of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .tables import SQL, Tables

QUERIES: dict = {}
ORACLES: dict = {}


def once(f: Callable) -> Callable:
    """Keeps f's result with the Tables object that it is made from."""

    def kept(t: Tables):
        memo = t.__dict__.setdefault("_memo", {})
        if f not in memo:
            memo[f] = f(t)
        return memo[f]

    return kept


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of Tables under a name. sql follows the common table expressions: either a SELECT, or
    further expressions, beginning with a comma, and a SELECT."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = f"{SQL}\n{sql}"
        return f

    return add
