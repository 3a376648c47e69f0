"""Registry of named queries and the SQL each one must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalogue:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"duplicate query name {name}")
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return keep


def collect() -> Catalogue:
    """All catalogue modules merged, in the order of the inventory."""
    from lagledger.plans import MODULES
    from importlib import import_module

    whole = Catalogue()
    for module in MODULES:
        part: Catalogue = import_module(f"lagledger.plans.{module}").cat
        for name, fn in part.queries.items():
            whole.query(name, part.sql.get(name))(fn)
    return whole
