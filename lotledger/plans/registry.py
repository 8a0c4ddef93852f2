"""Named queries over the given tables, each with its SQL counterpart where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lotledger.session import prepare

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Decorator: registers the function under `name`."""

        def add(build: Query) -> Query:
            def run(spark: SparkSession, folder: str) -> DataFrame:
                return build(prepare(spark), folder)

            if name in self.queries:
                raise ValueError(f"registered twice: {name}")
            self.queries[name] = run
            if sql is not None:
                self.sql[name] = sql
            return run

        return add
