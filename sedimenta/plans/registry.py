"""Names of queries, what runs them, and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, run: Query, oracle: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"query {name} is registered twice")
        self.queries[name] = run
        if oracle is not None:
            self.oracles[name] = oracle.strip()

    def query(self, name: str, oracle: str | None = None) -> Callable[[Query], Query]:
        def keep(run: Query) -> Query:
            self.add(name, run, oracle)
            return run

        return keep
