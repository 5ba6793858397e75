"""Exact dedup by sorting contents.

Normalised texts (A-Z lower-cased) are dealt out by range and sorted, so equal texts
become neighbours and are compared in full.  The sort key is the start of the text, 64
bits of all of it, the text and the id.  Ranges are cut by Spark's sampled splitters on
the key without the text, so what reaches the driver is about 100 short keys a partition,
and a group of copies of any size is cut between ids into many partitions.

A task streams through its sorted rows and holds the ids of one group and one text at a
time.  Groups inside a partition are finished there.  Those that share the key of a
partition's first or last row may go on in the next partition: their pieces, at most a few
per partition, are compared again by their full texts and added up.

Edge cases: a null text counts as empty; rows with a null id are last in their group and
stay only where no other row does; of rows that share an id and a text one stays; texts of
any length are compared whole; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import freeing, texts, written

#: Characters of a text that stand in the range key.
HEAD = 48
#: Rows that a task gives out at a time.
ROWS = 20_000
SCHEMA = "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string, part int, run int, t string"


class _Out:
    """Rows of finished groups and of pieces, as Arrow batches."""

    def __init__(self, part: int):
        self.part, self.rows, self.cols = part, 0, [[] for _ in range(8)]

    def add(self, piece: int | None, text: str, digest: str, ids: list[np.ndarray], none: list[np.ndarray]) -> None:
        own, missing = np.concatenate(ids), np.concatenate(none)
        n = len(own)
        first = np.arange(n) == 0
        column = pa.array(own, mask=missing)
        keep = pa.array(np.full(n, own[0]), mask=np.full(n, missing[0]))
        for col, x in zip(
            self.cols,
            (
                column,
                keep,
                pa.array(np.full(n, n)),
                pa.array(first),
                pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), pa.array([digest])).cast(pa.string()),
                pa.array(np.full(n, self.part, np.int32)),
                pa.array(np.full(n, piece or 0, np.int32), mask=np.full(n, piece is None)),
                # a piece's text goes with its first row
                pa.concat_arrays([pa.array([text if piece is not None else None], pa.string()), pa.nulls(n - 1, pa.string())]),
            ),
            strict=True,
        ):
            col.append(x)
        self.rows += n

    def batch(self) -> pa.RecordBatch:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        out = pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in self.cols], names=names)
        self.rows, self.cols = 0, [[] for _ in range(8)]
        return out


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of equal neighbours among sorted rows (head, digest, doc_id, t)."""
    out = _Out(TaskContext.get().partitionId())
    held: list[list] = []  # the groups of the current key: text, digest, ids, nulls
    key, first, piece = None, True, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        head, digest, ids, t = batch.columns
        keys, same = np.ones(n, bool), np.ones(n, bool)
        keys[0] = key is None or key != (digest[0].as_py(), head[0].as_py())
        same[0] = bool(held) and not keys[0] and held[-1][0] == t[0].as_py()
        if n > 1:
            same[1:] = pc.equal(t.slice(1), t.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            equal = pc.and_(pc.equal(digest.slice(1), digest.slice(0, n - 1)), pc.equal(head.slice(1), head.slice(0, n - 1)))
            keys[1:] = ~equal.to_numpy(zero_copy_only=False)
        numbers, none = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(~same)
        cuts = [*([0] if same[0] else []), *starts.tolist(), n]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if same[a]:
                held[-1][2].append(numbers[a:b])
                held[-1][3].append(none[a:b])
                continue
            if keys[a] and held:
                # the groups of the partition's first key are pieces, those of others are whole
                for g in held:
                    out.add(piece if first else None, *g)
                    piece += first
                held, first = [], False
                if out.rows >= ROWS:
                    yield out.batch()
            text = t[a].as_py()
            held.append([text, hashlib.sha256(text.encode()).hexdigest(), [numbers[a:b]], [none[a:b]]])
        key = (digest[n - 1].as_py(), head[n - 1].as_py())
    for g in held:
        out.add(piece, *g)
        piece += 1
    if out.rows:
        yield out.batch()


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = False) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of ``docs``.

    Of equal texts the row with the smallest id stays, or with ``largest`` the largest."""
    rows = texts(docs, id_col, text_col).select("doc_id", F.translate("text", string.ascii_uppercase, string.ascii_lowercase).alias("t"))
    order = F.desc_nulls_last("doc_id") if largest else F.asc_nulls_last("doc_id")
    keyed = rows.select(F.substring("t", 1, HEAD).alias("head"), F.xxhash64("t").alias("digest"), "doc_id", "t")
    dealt = keyed.repartitionByRange("head", "digest", order).sortWithinPartitions("head", "digest", "t", order)
    found = written(dealt.mapInArrow(freeing(_neighbours), SCHEMA), "content")
    pieces = found.where("t is not null").groupBy("t").agg(F.min(F.struct("part", "run", "doc_id")).alias("first"), F.sum("group_size").alias("all"), F.collect_list(F.struct("part", "run")).alias("own"))
    pieces = pieces.select(F.explode("own").alias("own"), "first", "all").select(F.col("own.part").alias("p"), F.col("own.run").alias("r"), "first", "all")
    open_ = found.where("run is not null").join(pieces, (F.col("part") == F.col("p")) & (F.col("run") == F.col("r")))
    at_first = (F.col("part") == F.col("first.part")) & (F.col("run") == F.col("first.run"))
    open_ = open_.select("doc_id", F.col("first.doc_id").alias("keep_id"), F.col("all").alias("group_size"), (F.col("kept") & at_first).alias("kept"), "text_sha256")
    return found.where("run is null").select(*open_.columns).unionByName(open_)
