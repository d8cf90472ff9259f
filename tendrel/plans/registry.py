"""Named queries: a function of (spark, folder) and, where SQL can say the same, its SQL text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


class Registry(dict[str, Query]):
    """Queries by name."""

    def query(self, name: str, sql: str | None = None) -> Callable:
        """Decorator that adds a query function under `name`."""

        def add(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
            if name in self:
                raise ValueError(f"two queries are named {name}")
            self[name] = Query(run, sql)
            return run

        return add
