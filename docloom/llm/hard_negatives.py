"""Hard-negative mining with an inverted multi-index and certified windows.

Vectors become integers, ``floor(scale * x)``, and a score is an integer inner product.
Each half of a vector is coded by its own codebook, fitted on at most ``FIT_ROWS`` rows
(those of the smallest hash); the two codes of a row name its cell, and every row is
indexed.  A cell bounds the scores of its members: per half, the anchor's product with the
centroid, plus the anchor's length times the cell's radius.

An anchor visits cells from the largest bound down, by a heap over the two sorted lists of
half bounds (each with the largest radius of its code).  It does so three times, each as
one Spark job for all anchors:

1. until the cells visited have ``PROBE_ROWS`` rows: the k-th best positive found is a
   lower bound of the last positive's score;
2. down to that bound: the positives are certified, and the k-th negative below the bound
   bounds the windows' ends;
3. down to the smaller of the windows' ends, or that negative: the windows are certified.

A cell that is left out cannot hold a row that would change the result, so results are
exact; how much is left out depends on the data (see README).

Rows of one first code are cut into chunks of ``CHUNK`` members and ``ANCHORS`` anchors and
a task takes one of each; per anchor it gives out k rows a window, so neither a full cell
nor a frequent label is met by one task.  What is broadcast are the codebooks and a table
of cells, at most ``CODES`` squared for each of at most ``LENGTHS`` vector lengths.

Edge cases: rows with a null id or label, or a vector that is null, empty or holds null or
non-finite numbers (also once scaled) take no part; of rows that share an id the one with
the smallest label, then vector, counts; vectors of different lengths have no score; ties
go to the smaller id; an anchor without positives, or whose positive scores are negative,
gives no rows; products beyond the range of long are held at its ends; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import drop_written, freeing, written
from docloom.llm.pq_dedup import kmeans

FIT_ROWS = 16_384
#: Most codes of a half, and rows that a cell has on average where the table allows.
CODES, CELL_ROWS = 256, 32
#: Vector lengths that get codebooks; rows of others are in one cell without a bound.
LENGTHS = 4
PROBE_ROWS = 2048
CHUNK, ANCHORS = 4096, 512
#: Added to bounds for the rounding of products of doubles, relative to their size.
ROUNDING = 1e-9
EXACT, MOST = 2.0**53, (1 << 63) - 1
KINDS = ("<i2", "<i4", "<f8")


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as hold them, after a byte that says how many."""
    most = np.abs(x).max()
    kind = 0 if most < 1 << 15 else 1 if most < 1 << 31 else 2
    return bytes([kind]) + x.astype(KINDS[kind]).tobytes()


def _unpack(rows: list[bytes]) -> np.ndarray:
    kinds = {r[0] for r in rows}
    if len(kinds) == 1:
        kind = KINDS[kinds.pop()]
        return np.frombuffer(b"".join(r[1:] for r in rows), kind).reshape(len(rows), -1).astype(float)
    return np.stack([np.frombuffer(r[1:], KINDS[r[0]]).astype(float) for r in rows])


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact and held in the range of long."""
    if a.shape[1] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in r] for r in m.tolist()], object)
    return np.array([[max(-MOST, min(MOST, v)) for v in r] for r in whole(a) @ whole(b).T], np.int64).reshape(len(a), len(b))


def whole_rows(vectors: DataFrame, label: Column, scale: int) -> DataFrame:
    """(vec_id, label, d, v): rows that take part, one per id, as packed whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(2)
            many = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            with np.errstate(all="ignore"):
                x = np.floor(scale * pc.fill_null(col.flatten(), np.nan).to_numpy(zero_copy_only=False).astype(float))
            ends = np.cumsum(many)
            out = [_pack(x[a:b]) if b > a and np.isfinite(x[a:b]).all() else None for a, b in zip((ends - many).tolist(), ends.tolist(), strict=True)]
            rows = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(many.astype(np.int32)), pa.array(out, pa.binary())], names=["vec_id", "label", "d", "v"])
            yield rows.filter(rows.column(3).is_valid())

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e")).where("vec_id is not null and label is not null and e is not null")
    rows = rows.mapInArrow(freeing(run), "vec_id long, label long, d int, v binary")
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "d", "v")).alias("r")).select("vec_id", "r.label", "r.d", "r.v")


def fit(rows: DataFrame, fit_rows: int = FIT_ROWS) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Codebooks of both halves for the most frequent vector lengths."""
    books = {}
    for length in rows.groupBy("d").count().orderBy(F.desc("count"), "d").limit(LENGTHS).collect():
        sample = rows.where(F.col("d") == length.d).orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows).select("v").toArrow()
        x = _unpack(sample.column("v").to_pylist())
        k = int(max(1, min(CODES, (length["count"] / CELL_ROWS) ** 0.5, len(x) // 8)))
        books[length.d] = (kmeans(x[:, : length.d // 2], k), kmeans(x[:, length.d // 2 :], k))
    return books


def _nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code of each half vector and its distance to that centroid."""
    code = (2 * x @ book.T - (book * book).sum(1)).argmax(1)
    return code, np.sqrt(((x - book[code]) ** 2).sum(1))


def coded(rows: DataFrame, books: dict) -> DataFrame:
    """``rows`` with their cell (i, j) and how far each half is from its centroid."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(2).to_numpy()
            code, far = np.zeros((2, len(lengths)), np.int32), np.zeros((2, len(lengths)))
            for d in np.unique(lengths).tolist():
                if d in shared.value:
                    own = np.flatnonzero(lengths == d)
                    x = _unpack(batch.column(3).take(pa.array(own)).to_pylist())
                    for h, part in enumerate((x[:, : d // 2], x[:, d // 2 :])):
                        code[h, own], far[h, own] = _nearest(part, shared.value[d][h])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code[0]), pa.array(code[1]), pa.array(far[0]), pa.array(far[1])], names=["vec_id", "label", "d", "v", "i", "j", "far1", "far2"])

    return rows.select("vec_id", "label", "d", "v").mapInArrow(freeing(run), "vec_id long, label long, d int, v binary, i int, j int, far1 double, far2 double")


def descending(one: np.ndarray, two: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(sum, i, j) over all pairs from the largest sum down: a heap over two sorted lists,
    which a pair enters once its upper and its left neighbour are out."""
    a, b = np.argsort(-one, kind="stable"), np.argsort(-two, kind="stable")
    heap, out = [(-(one[a[0]] + two[b[0]]), 0, 0)], np.zeros((len(a) + 1, len(b) + 1), bool)
    out[-1, :] = out[:, -1] = True
    while heap:
        total, p, q = heapq.heappop(heap)
        yield -total, int(a[p]), int(b[q])
        out[p, q] = True
        for x, y in ((p + 1, q), (p, q + 1)):
            if x < len(a) and y < len(b) and out[x - 1, y] and out[x, y - 1]:
                heapq.heappush(heap, (-(one[a[x]] + two[b[y]]), x, y))


def cells_above(one: np.ndarray, two: np.ndarray, least: float) -> np.ndarray:
    """Mask [i, j] of the pairs that ``descending`` yields before its sum is below ``least``."""
    return one[:, None] + two[None, :] >= least


class _Cells:
    """Cells of one vector length: how many rows, and the radii per half."""

    def __init__(self, books: tuple[np.ndarray, np.ndarray], rows: list[tuple]):
        self.books = books
        shape = len(books[0]), len(books[1])
        self.n, self.radius = np.zeros(shape, np.int64), np.zeros((2, *shape))
        for i, j, n, r1, r2 in rows:
            self.n[i, j], self.radius[:, i, j] = n, (r1, r2)

    def bounds(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bounds of both halves by code, and of each cell by its own radii."""
        halves = anchor[: len(anchor) // 2], anchor[len(anchor) // 2 :]
        dot = [b @ h for b, h in zip(self.books, halves, strict=True)]
        size = [np.sqrt(h @ h) for h in halves]
        slack = ROUNDING * (1 + sum(s * (np.sqrt((b * b).sum(1)).max() + r.max()) for s, b, r in zip(size, self.books, self.radius, strict=True)))
        one, two = dot[0] + size[0] * self.radius[0].max(1), dot[1] + size[1] * self.radius[1].max(0)
        own = dot[0][:, None] + dot[1][None, :] + size[0] * self.radius[0] + size[1] * self.radius[1]
        return one + slack, two, own + slack

    def first(self, anchor: np.ndarray, rows: int) -> np.ndarray:
        """Mask of the cells that come first and together have ``rows`` rows."""
        one, two, _ = self.bounds(anchor)
        out, had = np.zeros(self.n.shape, bool), 0
        for _, i, j in descending(one, two):
            if had >= rows:
                break
            out[i, j] = self.n[i, j] > 0
            had += self.n[i, j]
        return out

    def down_to(self, anchor: np.ndarray, least: float) -> np.ndarray:
        """Mask of the cells that may hold a score of at least ``least``."""
        one, two, own = self.bounds(anchor)
        return cells_above(one, two, least) & (own >= least) & (self.n > 0)


def _best(score: np.ndarray, ids: np.ndarray, ok: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by (score descending, id ascending) where ``ok`` holds."""
    at = np.flatnonzero(ok)
    if len(at) > k:
        least = np.partition(score[at], len(at) - k)[len(at) - k]
        at = at[score[at] >= least]
    return at[np.lexsort((ids[at], -score[at]))[:k]]


#: A found row: kind 0 is a positive, 1 a negative below ``top`` (a positive's score).
FOUND = "anchor_id long, kind int, top long, other_id long, score long"


def _round(index: DataFrame, anchors: DataFrame, cells: dict, sizes: DataFrame, k: int, low: int, probe: int | None, windows: bool) -> DataFrame:
    """What anchors (vec_id, label, d, v, least, tops) find in the cells they visit.

    With ``probe`` those are the first cells with that many rows, else all down to
    ``least`` (null: all).  Without ``windows`` the k best positives, and negatives of at
    most ``least``, are given out; else, for each of ``tops``, the k best negatives from
    ``low`` per cent of it up to it."""
    shared = index.sparkSession.sparkContext.broadcast({d: (c.books, [(i, j, int(c.n[i, j]), *c.radius[:, i, j].tolist()) for i, j in zip(*np.nonzero(c.n), strict=True)]) for d, c in cells.items()})

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {d: _Cells(*x) for d, x in shared.value.items()}
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                place, code, codes = [], [], []
                for n, (d, v, least) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True)):
                    if d not in known:
                        place.append(n), code.append(0), codes.append(b"")
                        continue
                    anchor = _unpack([v])[0]
                    mask = known[d].first(anchor, probe) if probe else known[d].down_to(anchor, -np.inf if least is None else least)
                    for i in np.flatnonzero(mask.any(1)).tolist():
                        place.append(n), code.append(i), codes.append(np.packbits(mask[i]).tobytes())
                rows = batch.take(pa.array(place, pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(code, pa.int32()), pa.array(codes, pa.binary())], names=["vec_id", "label", "d", "v", "least", "tops", "i", "codes"])

    visits = anchors.select("vec_id", "label", "d", "v", "least", "tops").mapInArrow(freeing(visit), "vec_id long, label long, d int, v binary, least long, tops array<long>, i int, codes binary")
    none = {"least": F.lit(None).cast("long"), "tops": F.lit(None).cast("array<long>"), "codes": F.lit(None).cast("binary")}
    columns = ["vec_id", "label", "d", "i", "v", "j", "least", "tops", "codes"]
    members = index.select("vec_id", "label", "d", "i", "v", "j").withColumns(none).select(*columns, F.lit(True).alias("member"))
    both = members.unionByName(visits.withColumn("j", F.lit(0)).select(*columns, F.lit(False).alias("member")))
    both = both.join(F.broadcast(sizes) if sizes.count() <= LENGTHS * CODES else sizes, ["d", "i"])
    own = F.pmod(F.xxhash64("vec_id"), F.when(F.col("member"), F.col("mc")).otherwise(F.col("qc"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("member"), F.col("qc")).otherwise(F.col("mc")) - 1))
    both = both.withColumn("own", own).withColumn("other", other)
    both = both.withColumn("m", F.when(F.col("member"), F.col("own")).otherwise(F.col("other"))).withColumn("q", F.when(F.col("member"), F.col("other")).otherwise(F.col("own")))
    schema = pa.schema([("anchor_id", pa.int64()), ("kind", pa.int32()), ("top", pa.int64()), ("other_id", pa.int64()), ("score", pa.int64())])

    def compare(table: pa.Table) -> pa.Table:
        member = table.column("member")
        rows, asked = table.filter(member), table.filter(pc.invert(member))
        out: list[tuple[int, int, int | None, np.ndarray, np.ndarray]] = []
        if rows.num_rows and asked.num_rows:
            ids, labels, j = (rows.column(c).to_numpy() for c in ("vec_id", "label", "j"))
            x, tops = _unpack(rows.column("v").to_pylist()), asked.column("tops").to_pylist()
            codes, leasts = asked.column("codes").to_pylist(), asked.column("least").to_pylist()
            who, own = asked.column("vec_id").to_pylist(), asked.column("label").to_pylist()
            for at in range(0, len(who), 64):
                part = range(at, min(at + 64, len(who)))
                score = _products(_unpack(asked.column("v").slice(at, len(part)).to_pylist()), x)
                for s, n in zip(score, part, strict=True):
                    seen = np.unpackbits(np.frombuffer(codes[n], np.uint8))[j].astype(bool) if codes[n] else np.ones(len(ids), bool)
                    same = labels == own[n]
                    if windows:
                        for top in sorted(set(tops[n])):
                            best = _best(s, ids, seen & ~same & (s <= top) & (s >= -(-low * top // 100)), k)
                            out.append((who[n], 1, top, ids[best], s[best]))
                        continue
                    best = _best(s, ids, seen & same & (ids != who[n]), k)
                    out.append((who[n], 0, None, ids[best], s[best]))
                    if leasts[n] is not None:
                        best = _best(s, ids, seen & ~same & (s <= leasts[n]), k)
                        out.append((who[n], 1, leasts[n], ids[best], s[best]))
        many = [len(o[3]) for o in out]
        spread = lambda values, kind: pa.array([v for v, n in zip(values, many, strict=True) for _ in range(n)], kind)
        joined = lambda c: pa.array(np.concatenate([o[c] for o in out] or [np.empty(0, np.int64)]).astype(np.int64))
        return pa.table([spread([o[0] for o in out], pa.int64()), spread([o[1] for o in out], pa.int32()), spread([o[2] for o in out], pa.int64()), joined(3), joined(4)], schema=schema)

    keys = ["d", "i", "m", "q"]
    return both.select(*keys, "member", "vec_id", "label", "j", "v", "least", "tops", "codes").groupBy(*keys).applyInArrow(compare, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "kind", "top").orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, label: Column, is_anchor: Column, k: int = 5, low: int = 80, scale: int = 256, probe_rows: int = PROBE_ROWS, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    An anchor's positives are its ``k`` best other rows of the same label; for each, the
    ``k`` best rows of another label whose score is at most the positive's and at least
    ``low`` per cent of it.  ``label`` and ``is_anchor`` are expressions on columns of
    ``vectors``, the second on ``vec_id`` alone."""
    rows = written(whole_rows(vectors, label, scale), "whole")
    books = fit(rows, fit_rows)
    index = written(coded(rows, books), "coded")
    counts = index.where(F.col("d").isin(list(books))).groupBy("d", "i", "j").agg(F.count("*").alias("n"), F.max("far1").alias("r1"), F.max("far2").alias("r2")).collect()
    cells = {d: _Cells(b, [(r.i, r.j, r.n, r.r1, r.r2) for r in counts if r.d == d]) for d, b in books.items()}
    size = index.groupBy("d", "i").agg(F.count("*").alias("n"))
    asked = index.where(is_anchor).groupBy("d").agg(F.count("*").alias("a"))
    chunks = lambda n, most: F.greatest(F.lit(1), F.ceil(F.col(n) / most)).cast("int")
    sizes = written(size.join(asked, "d").select("d", "i", chunks("n", CHUNK).alias("mc"), chunks("a", ANCHORS).alias("qc")), "sizes")
    anchors = index.where(is_anchor).select("vec_id", "label", "d", "v")
    none = {"least": F.lit(None).cast("long"), "tops": F.lit(None).cast("array<long>")}

    probed = _ranked(_round(index, anchors.withColumns(none), cells, sizes, k, low, probe_rows, False), k)
    bound = probed.where(F.col("rank") == k).select(F.col("anchor_id").alias("pa"), F.col("score").alias("least"))
    bounded = anchors.join(bound, F.col("vec_id") == F.col("pa"), "left").withColumn("tops", none["tops"])
    bounded = written(bounded.select("vec_id", "label", "d", "v", "least", "tops"), "bounds")

    near = written(_ranked(_round(index, bounded, cells, sizes, k, low, None, False), k), "positives")
    positives = near.where("kind = 0 and score >= 0")
    # a negative below every positive: windows end no lower than it
    floor = near.where((F.col("kind") == 1) & (F.col("rank") == k)).select(F.col("anchor_id").alias("fa"), F.col("score").alias("floor"))
    tops = positives.groupBy(F.col("anchor_id").alias("ta")).agg(F.collect_set("score").alias("tops"))
    ends = anchors.join(tops, F.col("vec_id") == F.col("ta")).join(floor, F.col("vec_id") == F.col("fa"), "left")
    ends = ends.withColumn("least", F.greatest(F.ceil(F.array_min("tops") / 100 * low).cast("long") - 1, "floor"))
    ends = written(ends.select("vec_id", "label", "d", "v", "least", "tops"), "ends")

    found = _ranked(_round(index, ends, cells, sizes, k, low, None, True), k).select(F.col("anchor_id").alias("a"), "top", "rank", F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
    wanted = positives.select("anchor_id", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = wanted.join(found, (F.col("anchor_id") == F.col("a")) & (F.col("positive_score") == F.col("top")))
    out = out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
    out = written(out, "negatives")
    for done in (rows, index, sizes, bounded, near, ends):
        drop_written(vectors.sparkSession, done)
    return out
