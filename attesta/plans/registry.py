"""The registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attesta.session import configure

QueryFn = Callable[[SparkSession, str], DataFrame]
RUN: dict[str, QueryFn] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query over a table folder, with the DuckDB SQL that must agree with it."""
    def register(run: QueryFn) -> QueryFn:
        if name in RUN:
            raise ValueError(f"query {name!r} is registered twice")

        def configured(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(configure(spark), sf_dir)

        RUN[name] = configured
        if sql is not None:
            SQL[name] = sql
        return run
    return register
