"""Integrity checks: each returns the rows that break a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repeated_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def dangling(rows: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return rows.join(parent.select(key).distinct(), key, "left_anti")


def outside_domain(rows: DataFrame, column: str, domain: list[str]) -> DataFrame:
    return rows.where(F.col(column).isNull() | ~F.col(column).isin(domain))


def bad_vectors(rows: DataFrame, column: str, dim: int) -> DataFrame:
    """Null vectors, and those of another length or with null or non-finite parts."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col(column).isNull() | (F.size(column) != dim) | F.coalesce(bad, F.lit(True)))


def nulls(rows: DataFrame, columns: list[str]) -> DataFrame:
    """How many nulls each required column holds."""
    return rows.agg(*[F.coalesce(F.sum(F.col(c).isNull().cast("long")), F.lit(0)).alias(c) for c in columns])
