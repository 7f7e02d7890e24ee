"""Where plans register: a name, a DataFrame function, and the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from proratio.plans.domain import Domain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a plan over the domain; without SQL it is checked by a test instead."""
    def register(plan: Callable[[Domain], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return plan(Domain(spark, folder))

        run.__name__, run.__doc__ = name, plan.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return register
