"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.QUERIES: dict[str, Query] = {}
        self.SQL: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Registers a query under its function's name, with the SQL that gives the same rows."""

        def register(f: Query) -> Query:
            self.QUERIES[f.__name__] = f
            if sql is not None:
                self.SQL[f.__name__] = sql
            return f

        return register
