"""Registration of queries with their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.plans.inputs import load, with_inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of a loader (name -> DataFrame) as query ``name``."""

    def wrap(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(lambda table: load(spark, sf_dir, table))

        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = with_inputs(sql)
        return build

    return wrap
