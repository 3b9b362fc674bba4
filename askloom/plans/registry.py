"""Registry of runnable queries and of the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from askloom.session import prepare

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    """A named SQL table built from the given tables and from other named tables."""
    _CTES[name] = (needs, body)


def with_ctes(body: str, *needs: str) -> str:
    """``body`` behind a WITH clause that defines everything it needs, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for need in _CTES[name][0]:
                visit(need)
            order.append(name)

    for name in needs:
        visit(name)
    if not order:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS MATERIALIZED ({_CTES[n][1]})" if "UNION ALL" not in _CTES[n][1]
                                          else f"{n} AS ({_CTES[n][1]})" for n in order) + "\n" + body


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query and, where SQL can say it, its oracle."""
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_ctes(sql, *needs)
        return fn
    return add
