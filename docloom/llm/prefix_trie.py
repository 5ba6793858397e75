"""Trie of conversation prefixes, with a broadcast skeleton and sorted shards.

A turn is 128 bits of the SHA-256 of its role and text, taken where the rows are read, so
texts are never shuffled.  A conversation's path is the row of its turns' digests; in the
order of (path, conv_id) the members of a node are neighbours.  Splitters from a sample
(``SAMPLE`` a shard, by hash of the id) cut that order into shards of like size.

*Skeleton.*  A node has members in two shards only if it lies on the path of a splitter
between them.  The trie of the splitter paths is broadcast: at most one splitter a shard,
of at most ``SPLITTER_TURNS`` turns.  Each shard streams through its sorted conversations
with a stack as deep as one path and finishes all other nodes; for skeleton nodes it gives
out partial aggregates, which are summed by Spark, and totals of subtrees are then
added up over the skeleton, whose size does not grow with the conversations.

*Ends.*  The ids of conversations that end at a node stand in ascending order in the
sorted shards.  Other nodes hash them there; those of a skeleton node go out as texts of
at most ``ENDS_BYTES``, and are hashed in order by tasks that hold one text at a time.

Edge cases: turns are ordered by turn, null first, ties by digest; a null role or text is
empty; rows without conv_id take no part; repeated rows are turns of their own; an empty
table gives an empty result; extra columns are ignored.  A very long text is one digest.
A task holds one conversation's path, 24 bytes a turn; copies of a conversation of more
than ``SPLITTER_TURNS`` turns stay in one shard, which streams through them.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import freeing, n_parts, written

#: Sampled conversations a shard.
SAMPLE = 8
#: Longest splitter path.
SPLITTER_TURNS = 1024
#: Bytes of decimal ids that leave a shard as one row.
ENDS_BYTES = 1 << 16
#: Bytes of a turn in a path.
WIDTH = 16
#: Conversations that share their first turns with the first of them.
FAMILY = 5

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: What a shard gives out: finished nodes (kind 0; ``skel`` is a parent on the skeleton),
#: partial aggregates (kind 1) and ids that end at a skeleton node (kind 2).
PART = f"kind int, skel int, {NODE}, ends binary"


def shared_turns(conv_id: Column) -> Column:
    """How many first turns a conversation takes from the first of its family."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 9


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, path, sizes): digests of the rebuilt turns in one row of bytes, and the
    UTF-8 bytes of their texts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("c"), F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("d"), F.octet_length(text).alias("b")).alias("r"))
    # array_sort puts null turns first, as a struct's null field is its smallest
    own = rows.groupBy("c").agg(F.array_sort(F.collect_list("r"), lambda x, y: F.when(x < y, -1).when(x > y, 1).otherwise(0)).alias("own"))
    base = own.where(F.col("c") % FAMILY == 0).select(F.col("c").alias("base_id"), F.slice("own", 1, 8).alias("base"))
    both = own.join(base, F.col("c") - F.col("c") % FAMILY == F.col("base_id"), "left").withColumn("h", shared_turns(F.col("c")).cast("int"))
    none = F.slice("own", 1, 0)
    first = F.when(F.col("h") > 0, F.slice(F.coalesce("base", none), F.lit(1), F.greatest("h", F.lit(1)))).otherwise(none)
    rest = F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))
    whole = both.select("c", F.concat(first, rest).alias("t"))
    return whole.select(F.col("c").alias("conv_id"), F.unhex(F.array_join(F.transform("t", lambda x: x["d"]), "")).alias("path"), F.transform("t", lambda x: x["b"]).alias("sizes"))


def splitters(rows: DataFrame, shards: int) -> list[tuple[bytes, int, list[int]]]:
    """Sorted (path, conv_id, sizes) where the next shard begins, from a bounded sample.

    A longer path is cut, and then begins before all that start with it."""
    cut = F.octet_length("path") > SPLITTER_TURNS * WIDTH
    picked = rows.orderBy(F.xxhash64("conv_id"), "conv_id").limit(SAMPLE * shards)
    picked = picked.select(F.substring("path", 1, SPLITTER_TURNS * WIDTH).alias("path"), F.when(cut, F.lit(-(1 << 63))).otherwise(F.col("conv_id")).alias("conv_id"), F.slice("sizes", 1, SPLITTER_TURNS).alias("sizes"))
    found = sorted((bytes(r.path), r.conv_id, list(r.sizes)) for r in picked.collect())
    return found[SAMPLE // 2 :: SAMPLE][: shards - 1]


def skeleton(cuts: list[tuple[bytes, int, list[int]]]) -> tuple[dict[tuple[int, bytes], int], list[int], list[int]]:
    """Number of each node on a splitter's path by its parent's number and last turn (the
    root is 0), its parent's number and the bytes of its last text; parents have smaller
    numbers."""
    number, parent, size = {}, [-1], [0]
    for path, _, sizes in cuts:
        at = 0
        for k, last in enumerate(_turns(path)):
            if (at, last) not in number:
                number[at, last] = len(parent)
                parent.append(at)
                size.append(sizes[k])
            at = number[at, last]
    return number, parent, size


def _turns(path: bytes) -> list[bytes]:
    return [path[k : k + WIDTH] for k in range(0, len(path), WIDTH)]


class _Node:
    """A node on the stack: its members in this shard and sums over its finished part."""

    __slots__ = ("skel", "size", "least", "n", "children", "leaves", "saved", "ends", "rows", "texts", "length")

    def __init__(self, skel: int, size: int):
        self.skel, self.size, self.least, self.n, self.children, self.leaves, self.saved = skel, size, None, 0, 0, 0, 0
        self.ends, self.rows, self.texts, self.length = None, [], [], 0


def _walk(batches: Iterator[pa.RecordBatch], number: dict[tuple[int, bytes], int]) -> Iterator[list[tuple]]:
    """Rows of ``PART`` from sorted (path, conv_id, sizes)."""
    out: list[tuple] = []
    stack: list[_Node] = [_Node(0, 0)]
    path, empty = b"", hashlib.sha256().hexdigest()

    def flush_ends(node: _Node) -> None:
        if node.texts:
            out.append((2, node.skel, node.texts[0], *[None] * 7, ",".join(map(str, node.texts)).encode()))
            node.texts, node.length = [], 0

    def close() -> None:
        node, depth = stack.pop(), len(stack)
        up = stack[-1] if stack else None
        if up is not None:
            up.n += node.n
            up.least = node.least if up.least is None else min(up.least, node.least)
        if node.skel >= 0:
            flush_ends(node)
            out.append((1, node.skel, node.least, depth, None, node.n, node.children, node.leaves, node.saved, None, None))
        else:
            leaves, saved = node.leaves or 1, node.saved + (node.n - 1) * node.size
            row = (node.least, depth, node.n, node.children, leaves, saved, node.ends.hexdigest() if node.ends else empty)
            up.children += 1
            up.leaves += leaves
            up.saved += saved
            if up.skel >= 0:
                out.append((0, up.skel, row[0], depth, None, *row[2:], None))
            else:
                up.rows.append(row)
        if node.rows:
            # only now is it known who stands for the parent
            out.extend((0, None, r[0], r[1], node.least, *r[2:], None) for r in node.rows)
        node.rows = []

    any_row = False
    for batch in batches:
        own, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        flat, ends = batch.column(2).flatten().to_numpy(zero_copy_only=False), np.cumsum(pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)).tolist()
        at = 0
        for p, c, end in zip(own, ids, ends, strict=True):
            any_row = True
            turns, common = len(p) // WIDTH, 0
            if p == path:
                common = turns
            else:
                # the first byte that differs, by halves
                low, high = 0, min(len(p), len(path))
                while low < high:
                    mid = (low + high + 1) // 2
                    low, high = (mid, high) if p[low:mid] == path[low:mid] else (low, mid - 1)
                common = low // WIDTH
            while len(stack) - 1 > common:
                close()
            for d in range(common + 1, turns + 1):
                # below a node off the skeleton nothing is on it
                skel = number.get((stack[-1].skel, p[(d - 1) * WIDTH : d * WIDTH]), -1) if stack[-1].skel >= 0 else -1
                stack.append(_Node(skel, int(flat[at + d - 1])))
            top = stack[-1]
            top.n += 1
            top.least = c if top.least is None else min(top.least, c)
            if top.skel >= 0:
                top.texts.append(c)
                top.length += 21
                if top.length > ENDS_BYTES:
                    flush_ends(top)
            elif top.ends is None:
                top.ends = hashlib.sha256(str(c).encode())
            else:
                top.ends.update(f",{c}".encode())
            path, at = p, end
            if len(out) >= 10_000:
                yield out
                out.clear()
    while any_row and stack:
        close()
    if out:
        yield out


def trie(turns: DataFrame, shards: int | None = None) -> DataFrame:
    """Nodes of the trie of all rebuilt conversations, with the columns of ``NODE``."""
    spark = turns.sparkSession
    shards = shards or n_parts(spark)
    rows = written(paths(turns), "paths")
    cuts = splitters(rows, shards)
    number, parent, size = skeleton(cuts)
    shared = spark.sparkContext.broadcast(([(p, c) for p, c, _ in cuts], number))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value[0]
        for batch in batches:
            shard = [bisect_right(keys, key) for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard, pa.int32())], names=["path", "conv_id", "sizes", "shard"])

    kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 7, pa.string(), pa.binary()]
    names = [c.split()[0] for c in PART.split(", ")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in _walk((b.select([0, 1, 2]) for b in batches if b.num_rows), shared.value[1]):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    placed = rows.select("path", "conv_id", "sizes").mapInArrow(place, "path binary, conv_id long, sizes array<int>, shard int")
    placed = placed.repartitionById(shards, F.col("shard")).sortWithinPartitions("path", "conv_id")
    found = written(placed.mapInArrow(freeing(walk), PART), "nodes")

    # the skeleton: sums over shards, then totals of subtrees over its nodes
    sums = found.where("kind = 1").groupBy("skel").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]).collect()
    top = _rolled({r.skel: r for r in sums}, parent, size)
    known = spark.createDataFrame(top, "skel int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    ends = _ends(found.where("kind = 2").select("skel", "conv_id", "ends"))
    none = hashlib.sha256().hexdigest()
    columns = [c.split()[0] for c in NODE.split(", ")]
    upper = known.join(ends.withColumnRenamed("skel", "s"), F.col("skel") == F.col("s"), "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(none)))
    lower = found.where("kind = 0")
    above = F.broadcast(known.select(F.col("skel").alias("s"), F.col("conv_id").alias("above")))
    lower = lower.join(above, F.col("skel") == F.col("s"), "left").withColumn("parent_conv_id", F.coalesce("above", "parent_conv_id"))
    return lower.select(*columns).unionByName(upper.select(*columns))


def _rolled(sums: dict, parent: list[int], size: list[int]) -> list[tuple]:
    """Whole skeleton nodes from the sums of their parts off the skeleton."""
    n = len(parent)
    leaves, saved, children = [0] * n, [0] * n, [0] * n
    for k in reversed(range(n)):
        if k not in sums:
            continue
        r = sums[k]
        children[k] += r.n_children
        leaves[k] = (leaves[k] + r.n_leaves) or 1
        saved[k] += r.saved_tokens + (r.n_convs - 1) * size[k]
        if k:
            children[parent[k]] += 1
            leaves[parent[k]] += leaves[k]
            saved[parent[k]] += saved[k]
    return [(k, r.conv_id, r.depth, sums[parent[k]].conv_id if k else None, r.n_convs, children[k], leaves[k], saved[k]) for k, r in sums.items()]


def _ends(rows: DataFrame) -> DataFrame:
    """(skel, ends_sha256) from texts of ids in the order of their first ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            out = []
            for skel, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if skel != now:
                    if now is not None:
                        out.append((now, digest.hexdigest()))
                    now, digest = skel, hashlib.sha256(text)
                else:
                    digest.update(b"," + text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out])], names=["skel", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([digest.hexdigest()])], names=["skel", "ends_sha256"])

    return rows.repartition("skel").sortWithinPartitions("skel", "conv_id").mapInArrow(run, "skel int, ends_sha256 string")
