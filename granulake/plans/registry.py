"""Registered queries: a name, a Spark plan over the given tables, and its SQL twin if there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from granulake.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a plan. `sql` gives the same rows and column names on the same tables."""

    def register(plan):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plan(prepare(spark), sf_dir)

        run.__name__ = name
        run.__doc__ = plan.__doc__
        run.__module_name__ = plan.__module__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return register
