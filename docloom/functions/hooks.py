"""Model hooks: batched functions over partitions, with deterministic defaults."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

BATCH = 16


def embed(rows: DataFrame, model: Callable[[list[str]], list[list[float]]], text: str = "text", most_chars: int = 32_000) -> DataFrame:
    """``rows`` with ``embedding``: ``model`` sees texts in order, ``BATCH`` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ts = [(t or "")[:most_chars] for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            out = [v for i in range(0, len(ts), BATCH) for v in model(ts[i : i + BATCH])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float32()))], names=[*batch.schema.names, "embedding"])

    keep = rows.drop("embedding")
    return keep.mapInArrow(run, StructType([*keep.schema.fields, StructField("embedding", ArrayType(FloatType()))]))


def fill_gaps(rows: DataFrame, model: Callable[[list[str]], list[dict[str, str]]], columns: list[str], text: str = "text") -> DataFrame:
    """``rows`` with null ``columns`` filled by what ``model`` derives from the text.

    Only rows with a gap are sent, ``BATCH`` at a time; given values always win."""
    gap = F.lit(False)
    for c in columns:
        gap |= F.col(c).isNull()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            said = [d for i in range(0, len(ts), BATCH) for d in model(ts[i : i + BATCH])]
            out = []
            for name, col in zip(batch.schema.names, batch.columns, strict=True):
                if name in columns:
                    col = pa.array([v if v is not None else d.get(name) for v, d in zip(col.to_pylist(), said, strict=True)], pa.string())
                out.append(col)
            yield pa.RecordBatch.from_arrays(out, names=batch.schema.names)

    return rows.where(~gap).unionByName(rows.where(gap).mapInArrow(run, rows.schema))


def hashed_vector(text: Column, dim: int = 64) -> Column:
    """Default embedding: counts of words by a hash, in ``dim`` places."""
    words = F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: w != "")
    places = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") % dim)
    counted = lambda held: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(held, lambda p: p == i)).cast("double"))
    # as an array's element the places are computed once, not once a place
    return F.get(F.transform(F.array(places), counted), F.lit(0))


def lexical_overlap(query: Column, text: Column) -> Column:
    """Default reranker: share of the query's distinct words that the text has."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z]+"), lambda w: w != ""))
    return F.when(F.size(words(query)) > 0, F.size(F.array_intersect(words(query), words(text))) / F.size(words(query))).otherwise(0.0)


def regex_entities(rows: DataFrame, text: str = "text") -> DataFrame:
    """Default entity extraction: money, dates, runs of capitalized words."""
    rules = {"MONEY": r"[$][0-9][0-9,.]*", "DATE": r"[0-9]{4}-[0-9]{2}-[0-9]{2}", "NAME": r"[A-Z][a-z]+(?: [A-Z][a-z]+)+"}

    def found(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), lambda n: F.struct(F.lit(kind).alias("type"), n.alias("name")))

    each = F.concat(*[found(k, p) for k, p in rules.items()])
    return rows.select("document_id", F.explode(each).alias("e")).groupBy("document_id", "e.type", "e.name").agg(F.count("*").alias("n"))
