"""Registered queries: name -> (Spark callable, DuckDB text or None), by family."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factorwise.plans.sqlviews import q

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(fn: Query) -> Query:
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = q(sql)
            return fn

        return register


FAMILIES = (
    "ingest", "lookup", "dedup", "matching", "graph", "features", "scoring",
    "learning", "evaluation", "cases", "retrieval", "dashboard", "streams",
)


def load(families=FAMILIES) -> Catalog:
    import importlib

    whole = Catalog()
    for family in families:
        part = importlib.import_module(f"factorwise.plans.catalog.{family}").catalog
        whole.queries.update(part.queries)
        whole.sql.update(part.sql)
    return whole
