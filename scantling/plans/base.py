"""How a query is registered: a function of (spark, folder) and its SQL, under a name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry(dict):
    """name -> (query, SQL or None)."""

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            if name in self:
                raise ValueError(f"two queries named {name}")
            self[name] = (f, sql)
            return f

        return put
