"""Named queries over the driver's tables, with an equivalent SQL text where SQL can say it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from intakeforge.session import ensure_checkpoint_dir, ship

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Collects queries and their SQL under one name each."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            key = name or f.__name__

            @functools.wraps(f)
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                ship(spark)
                ensure_checkpoint_dir(spark)
                return f(spark, sf_dir)

            if key in self.queries:
                raise ValueError(f"{key} is registered twice")
            self.queries[key] = run
            if sql:
                self.sql[key] = sql
            return f

        return keep
