"""A stored inverted-list index over chunk vectors, searched by later jobs.

``path/lists`` holds the chunks with their unit vectors, partitioned by list; ``path/centres``
the centroid of each list and how many rows it has.  Lists are about the root of the number
of chunks.  A search joins the lists that its queries probe, so Spark prunes the others from
the scan at run time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.search import Block, _vectors, block_best, ranked_blocks, top_k, with_chunks

#: Chunks that centroids are fitted on at most (those of the smallest hash), and how many
#: of these a list must have.
FIT_ROWS, LIST_SAMPLE = 65_536, 16


def _unit(x: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.sqrt((x * x).sum(1))[:, None]


def fit_centres(chunks: DataFrame, lists: int, fit_rows: int = FIT_ROWS, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Unit centroids by spherical k-means on a bounded sample."""
    sample = chunks.where("embedding is not null").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(fit_rows).select("embedding").toArrow().column(0).combine_chunks()
    dim = max((len(v) for v in sample.to_pylist()), default=1)
    x = _unit(_vectors(sample, dim))
    x = x[np.isfinite(x).all(1)]
    k = max(1, min(lists, len(x) // LIST_SAMPLE))
    if not len(x):
        return np.zeros((1, dim))
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        home = np.concatenate([(x[a : a + 8192] @ centres.T).argmax(1) for a in range(0, len(x), 8192)])
        total = np.zeros_like(centres)
        np.add.at(total, home, x)
        full = np.abs(total).sum(1) > 0
        centres[full] = _unit(total[full])
    return centres


def build(chunks: DataFrame, path: str, lists: int | None = None, fit_rows: int = FIT_ROWS) -> None:
    """Write the index of ``chunks`` (chunk_id, document_id, embedding, ...) to ``path``.

    Chunks without a vector that can be compared are in list -1, which no query probes."""
    spark = chunks.sparkSession
    centres = fit_centres(chunks, lists or max(1, round(chunks.count() ** 0.5)), fit_rows)
    shared = spark.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(_vectors(batch.column(batch.schema.get_field_index("embedding")), shared.value.shape[1]))
            home = np.where(np.isfinite(x).all(1), np.nan_to_num(x @ shared.value.T).argmax(1), -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32))], names=[*batch.schema.names, "list"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields)
    placed = chunks.mapInArrow(place, f"{fields}, `list` int")
    # a list is a file or a few; rows of a large one are not all brought to one task
    placed.repartition("list", F.pmod(F.xxhash64("chunk_id"), F.lit(4))).write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    rows = spark.read.parquet(f"{path}/lists").groupBy("list").agg(F.count("*").alias("n"))
    known = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "list int, centre array<double>")
    known.join(rows, "list", "left").fillna(0, ["n"]).coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


def probes(queries: Block, centres: np.ndarray, most: int) -> list[tuple[int, int, int]]:
    """(number of the query, list, place from 1) of the nearest lists of each query."""
    near = np.argsort(-np.nan_to_num(_unit(queries.vectors) @ centres.T), axis=1, kind="stable")[:, :most]
    return [(k, int(c), r + 1) for k, row in enumerate(near) for r, c in enumerate(row)]


def visited(block: DataFrame, path: str, most: int) -> tuple[DataFrame, Block]:
    """Rows of the lists that the block's queries probe, with ``_asked``, the numbers of
    the queries that do, and the block."""
    spark = block.sparkSession
    known = spark.read.parquet(f"{path}/centres").orderBy("list").toArrow()
    centres = np.array(known.column("centre").to_pylist(), float)
    asked = Block(block)
    wanted = spark.createDataFrame(probes(asked, centres, most), "_q int, list int, place int")
    wanted = wanted.where(F.col("place") <= most).groupBy("list").agg(F.collect_list("_q").alias("_asked"))
    # at most a block of queries times their probes; the join prunes partitions at run time
    return spark.read.parquet(f"{path}/lists").join(F.broadcast(wanted), "list"), asked


def search(path: str, queries: DataFrame, access: DataFrame | None, k: int = 10, most: int = 8, enforce_acl: bool = True) -> DataFrame:
    """Top k of each query among its ``most`` nearest lists: chunk columns, score, rank."""
    if enforce_acl and access is None:
        raise ValueError("an access table is required; enforce_acl=False searches without one")
    spark = queries.sparkSession

    def one(block: DataFrame) -> DataFrame:
        rows, asked = visited(block, path, most)
        return top_k(block_best(asked, rows, access if enforce_acl else None, k), k)

    ranked = ranked_blocks(queries, one)
    return with_chunks(ranked, queries, spark.read.parquet(f"{path}/lists").drop("list"))


def share_read(path: str, queries: DataFrame, most: int) -> DataFrame:
    """(query_id, share): how much of the index a query's lists hold."""
    spark = queries.sparkSession
    sizes = spark.read.parquet(f"{path}/centres").orderBy("list").toArrow()
    n = np.array(sizes.column("n").to_pylist(), float)
    centres = np.array(sizes.column("centre").to_pylist(), float)

    def block_share(block: DataFrame) -> DataFrame:
        asked = Block(block)
        total = np.zeros(len(asked.ids))
        for k, c, _ in probes(asked, centres, most):
            total[k] += n[c]
        return spark.createDataFrame([(i, float(t / max(1.0, n.sum()))) for i, t in zip(asked.ids, total, strict=True)], "query_id long, share double")

    return ranked_blocks(queries, block_share)


def index_exists(spark: SparkSession, path: str) -> bool:
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/centres/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)
