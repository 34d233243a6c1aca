"""Where queries and the SQL that gives the same rows are listed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Named SQL views over the driver's tables, each after those it reads.
VIEWS: dict[str, str] = {}


def with_views(names: str, body: str) -> str:
    """``body`` with the named views, and those that they read, in front of it."""
    wanted: set[str] = set()

    def want(name: str) -> None:
        if name not in wanted:
            wanted.add(name)
            for other in VIEWS:
                if other != name and f" {other} " in f" {VIEWS[name]} ".replace("(", " ").replace(")", " ").replace(",", " ").replace("\n", " "):
                    want(other)

    for name in names.split():
        want(name)
    listed = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in wanted)
    return f"WITH {listed}\n{body}" if listed else body


def query(name: str, sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = with_views(views, sql)
        return f

    return put
