"""Registration of queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidex.session import table

Query = Callable[[SparkSession, str], DataFrame]


class Book:
    """Queries of one family by operator id."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Callable[[Callable[[str], DataFrame]], DataFrame]], Query]:
        """Register f(t), where t(name) gives a table of the data directory, under an id."""

        def wrap(f: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Query:
            def run(spark: SparkSession, d: str) -> DataFrame:
                return f(lambda n: table(spark, d, n))

            run.__doc__, run.__name__ = f.__doc__, name
            self.queries[name] = run
            if sql:
                self.oracle[name] = sql
            return run

        return wrap
