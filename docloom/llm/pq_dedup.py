"""Embedding near-dedup with product quantisation and inverted lists.

Coarse centroids (about the root of the number of vectors) and, on the residuals, one
codebook per subspace are fitted on at most ``FIT_ROWS`` vectors (those with the
smallest hash); every vector is indexed.  A vector lies in its nearest list, with its
residual codes.

*Probes.*  A vector within the threshold's distance ``r`` of a query lies in another list
only if it is beyond the plane between the two lists' centroids.  The query searches all
lists whose plane is at most ``REACH * r / sqrt(d)`` away, ``d`` being the effective
dimension of the residuals: a step of length ``r`` in a random direction goes further
along one direction once in forty times at ``REACH`` 2, and of two linked vectors either
may find the other.  The number of probes follows from that, with no fixed number.

*Distances.*  In a list the squared distance to each member is summed from a table of
(subspace, code) terms.  A member is at most its own code's error further from a query
by its code than by itself, so members within ``(r + error) ** 2`` are re-ranked by exact
cosine in double precision, and no link inside a searched list is lost.

Lists are cut into chunks of ``CHUNK`` members and ``CHUNK`` queries, and a task takes one
chunk of each, so a list with a third of all vectors is many tasks and no task's memory
grows with it.  A task gives out, per vector, how many links it has there, and a forest
that connects what is linked; no list of pairs is made.  Identical vectors are searched
once.  No cap on partners or candidates.

Vectors of different lengths are not linked; each length is searched by itself, the
``LENGTHS`` most frequent ones by lists and codes, the others against each other.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite numbers link
with nothing but keep their row; so do those with a null id; rows that share an id are
judged each by its own vector, and a component goes by its smallest id; ties do not occur,
as all pairs at the threshold are links; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import drop_written, freeing, written
from docloom.llm.components import components

FIT_ROWS = 16_384
SUBSPACES = 8
CODES = 64
REACH = 2.0
CHUNK = 1024
#: Added to the squared-distance bound for single precision of the tables.
ROUNDING = 1e-3
#: Fitted vectors that a coarse list must have.
LIST_SAMPLE = 8
#: Vector lengths that get a quantiser.
LENGTHS = 4
#: Pairs that the tables let through and that are re-ranked at a time.
RERANK = 1 << 15


def _dim() -> Column:
    return (F.octet_length("v") / 8).cast("int")


def unit(vectors: DataFrame) -> DataFrame:
    """(vec_id, node, v) of every row: the vector scaled to length one, as bytes, and 64
    bits that stand for it; both null where it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(1)
            many = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            x = pc.fill_null(col.flatten(), np.nan).to_numpy(zero_copy_only=False).astype(float)
            ends = np.cumsum(many)
            out: list[bytes | None] = []
            for a, b in zip((ends - many).tolist(), ends.tolist(), strict=True):
                own = x[a:b]
                most = np.abs(own).max(initial=0.0)
                if most > 0 and np.isfinite(most):
                    own = own / most
                    out.append((own / np.sqrt(own @ own) + 0.0).tobytes())
                else:
                    out.append(None)
            out = [None if i is None else v for i, v in zip(batch.column(0).to_pylist(), out, strict=True)]
            node = [None if v is None else int.from_bytes(hashlib.md5(v, usedforsecurity=False).digest()[:8], "little", signed=True) for v in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "node", "v"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    return rows.mapInArrow(freeing(run), "vec_id long, node long, v binary")


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids by Lloyd's rounds from a seeded choice of rows."""
    k = min(k, len(x))
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = (x @ c.T * 2 - (c * c).sum(1)).argmax(1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


class Quantiser:
    """Coarse centroids, residual codebooks of the subspaces between ``cuts``, and the
    effective dimension of the residuals."""

    def __init__(self, coarse: np.ndarray, cuts: np.ndarray, books: list[np.ndarray], spread: float = 1.0):
        self.coarse, self.cuts, self.books, self.spread = coarse, cuts, books, spread
        square = (coarse * coarse).sum(1)
        self.apart = np.sqrt(np.maximum(square[:, None] + square - 2 * coarse @ coarse.T, 1e-12))

    @classmethod
    def fitted(cls, sample: np.ndarray, lists: int) -> Quantiser:
        out = cls(kmeans(sample, lists), np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int), [])
        residual = sample - out.coarse[out.homes(sample)]
        variance = np.linalg.eigvalsh(residual.T @ residual)
        out.spread = float(variance.sum() ** 2 / max((variance**2).sum(), 1e-300)) or 1.0
        out.books += [kmeans(residual[:, a:b], CODES) for a, b in zip(out.cuts[:-1], out.cuts[1:], strict=True)]
        return out

    def __getstate__(self):
        return self.coarse, self.cuts, self.books, self.spread

    def __setstate__(self, state):
        self.__init__(*state)

    def _to_centres(self, x: np.ndarray) -> np.ndarray:
        return (x * x).sum(1)[:, None] + (self.coarse * self.coarse).sum(1) - 2 * x @ self.coarse.T

    def homes(self, x: np.ndarray) -> np.ndarray:
        """The list that each vector lies in."""
        return np.concatenate([self._to_centres(x[k : k + 4096]).argmin(1) for k in range(0, len(x), 4096)] or [np.empty(0, np.int64)])

    def probes(self, x: np.ndarray, homes: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
        """(vector, list): lists that a step of this length may lead to."""
        d = self._to_centres(x)
        plane = (d - d[np.arange(len(x)), homes][:, None]) / (2 * self.apart[homes])
        plane[np.arange(len(x)), homes] = 0
        return np.nonzero(plane <= step)

    def encode(self, residual: np.ndarray) -> np.ndarray:
        out = []
        for book, a, b in zip(self.books, self.cuts[:-1], self.cuts[1:], strict=True):
            part = residual[:, a:b]
            out.append((2 * part @ book.T - (book * book).sum(1)).argmax(1).astype(np.uint8))
        return np.stack(out, 1)

    def errors(self, residual: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Distance of each residual to what its codes stand for."""
        parts = [residual[:, a:b] - book[codes[:, j]] for j, (book, a, b) in enumerate(zip(self.books, self.cuts[:-1], self.cuts[1:], strict=True))]
        return np.sqrt(sum((p * p).sum(1) for p in parts))

    def distances(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances of residual queries to coded residuals, from tables."""
        total = np.zeros((len(queries), len(codes)), np.float32)
        for j, (book, a, b) in enumerate(zip(self.books, self.cuts[:-1], self.cuts[1:], strict=True)):
            q = queries[:, a:b]
            table = (q * q).sum(1)[:, None] + (book * book).sum(1) - 2 * q @ book.T
            total += table.astype(np.float32)[:, codes[:, j]]
        return total


def fit(rows: DataFrame, fit_rows: int = FIT_ROWS) -> dict[int, Quantiser]:
    """Quantisers of the ``LENGTHS`` most frequent vector lengths, from bounded samples.

    Vectors of other lengths are one list each length, compared in full."""
    out = {}
    for usual in rows.groupBy(_dim().alias("d")).count().orderBy(F.desc("count"), "d").limit(LENGTHS).collect():
        sample = rows.where(_dim() == usual.d).orderBy(F.xxhash64("node"), "node").limit(fit_rows).select("v").toArrow()
        x = np.frombuffer(b"".join(sample.column("v").to_pylist())).reshape(-1, usual.d)
        out[usual.d] = Quantiser.fitted(x, int(max(1, min(usual["count"] ** 0.5, len(x) // LIST_SAMPLE))))
    return out


def _joined(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Forest ``up`` (parents have smaller numbers) with ``a`` and ``b`` connected."""
    while len(a):
        x, y = up[a], up[b]
        open_ = x != y
        a, b = a[open_], b[open_]
        np.minimum.at(up, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while (up != up[up]).any():
            up = up[up]
    return up


def links(rows: DataFrame, threshold: float = 0.9, reach: float = REACH, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Written rows (a, b, n) about distinct unit vectors (node, v, copies): with ``b``
    null, ``n`` linked rows of node ``a``; else ``a`` and ``b`` are connected."""
    spark = rows.sparkSession
    schema = "a long, b long, n long"
    fitted = fit(rows, fit_rows)
    # plain arrays, so that a task makes its quantisers with the code that came with it
    shared = spark.sparkContext.broadcast({d: q.__getstate__() for d, q in fitted.items()})
    bound = max(2 - 2 * threshold, 0.0)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {d: Quantiser(*state) for d, state in shared.value.items()}
        for whole in batches:
            lengths = whole.column(3).to_numpy()
            parts = [whole.filter(pa.array(lengths == d)) for d in np.unique(lengths)]
            for batch in (p.slice(k, 2048) for p in parts for k in range(0, p.num_rows, 2048)):
                n, dim = batch.num_rows, batch.column(3)[0].as_py()
                x = np.frombuffer(b"".join(batch.column(1).to_pylist())).reshape(n, dim)
                if dim in known:
                    q = known[dim]
                    home = q.homes(x)
                    who, where = q.probes(x, home, reach * np.sqrt(bound / q.spread))
                    residual = x - q.coarse[home]
                    codes = q.encode(residual)
                    errors = q.errors(residual, codes)
                else:
                    home, who, where = np.zeros(n, np.int64), np.arange(n), np.zeros(n, np.int64)
                    codes, errors = np.zeros((n, 0), np.uint8), np.zeros(n)
                cut = np.searchsorted(who, np.arange(n + 1))
                at = pa.array(np.concatenate([np.arange(n), who]))
                none = [None] * len(who)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n + len(who), dim, np.int32)),
                        pa.array(np.concatenate([home, where]).astype(np.int32)),
                        pa.array(np.r_[np.ones(n, bool), np.zeros(len(who), bool)]),
                        batch.column(0).take(at),
                        batch.column(2).take(at),
                        pa.array(np.concatenate([home, home[who]]).astype(np.int32)),
                        pa.array([*(where[a:b].astype("<i4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)), *none], pa.binary()),
                        pa.array([*(c.tobytes() for c in codes), *none], pa.binary()),
                        pa.array(np.r_[errors, np.zeros(len(who))]),
                        batch.column(1).take(at),
                    ],
                    names=["d", "list", "member", "node", "copies", "home", "probes", "codes", "error", "v"],
                )

    placed = rows.select("node", "v", "copies", _dim().alias("d"))
    placed = placed.mapInArrow(freeing(assign), "d int, list int, member boolean, node long, copies long, home int, probes binary, codes binary, error double, v binary")
    # chunks of lists: each member chunk meets each query chunk of its list
    size = written(placed.groupBy("d", "list", "member").agg(F.count("*").alias("n")), "lists")
    n = size.groupBy("d", "list").agg(*[F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("member") == m, F.col("n")).otherwise(0)) / CHUNK)).cast("int").alias(x) for m, x in ((True, "mc"), (False, "qc"))])
    # one row a list; only where many lengths have one each is that more than the lists fitted
    placed = placed.join(F.broadcast(n) if n.count() <= 1 << 17 else n, ["d", "list"])
    own = F.when(F.col("member"), F.pmod(F.xxhash64("node"), F.col("mc"))).otherwise(F.pmod(F.xxhash64("node"), F.col("qc"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("member"), F.col("qc")).otherwise(F.col("mc")) - 1))
    placed = placed.withColumn("own", own).withColumn("other", other)
    placed = placed.withColumn("m", F.when(F.col("member"), F.col("own")).otherwise(F.col("other"))).withColumn("q", F.when(F.col("member"), F.col("other")).otherwise(F.col("own")))

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        qz = Quantiser(*shared.value[dim]) if dim in shared.value else None
        member = table.column("member").to_numpy()
        ids, copies, home = (table.column(c).to_numpy() for c in ("node", "copies", "home"))
        mi, qi = np.flatnonzero(member), np.flatnonzero(~member)
        up, n = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        if len(mi) and len(qi):
            x = np.frombuffer(b"".join(table.column("v").to_pylist())).reshape(len(ids), dim)
            own = table.filter(pa.array(member))
            # which lists a member searches itself
            searched = [np.frombuffer(p, "<i4") for p in own.column("probes").to_pylist()]
            searches = np.zeros((len(mi), len(qz.coarse) if qz else 1), bool)
            searches[np.repeat(np.arange(len(mi)), list(map(len, searched))), np.concatenate(searched)] = True
            if qz:
                codes = np.frombuffer(b"".join(own.column("codes").to_pylist()), np.uint8).reshape(len(mi), -1)
                most = (np.sqrt(bound) + own.column("error").to_numpy()) ** 2 + ROUNDING
                centre = qz.coarse[key[1].as_py()]
            for k in range(0, len(qi), 64):
                part = qi[k : k + 64]
                # only what the tables let through is compared by its own numbers
                r, c = np.nonzero(qz.distances(x[part] - centre, codes) <= most) if qz else np.nonzero(np.ones((len(part), len(mi)), bool))
                ok = ids[part[r]] != ids[mi[c]]
                r, c = r[ok], c[ok]
                cosine = np.concatenate([np.einsum("ij,ij->i", x[part[r[a : a + RERANK]]], x[mi[c[a : a + RERANK]]]) for a in range(0, len(r), RERANK)] or [np.empty(0)])
                ok = cosine >= threshold
                a, b, c = part[r[ok]], mi[c[ok]], c[ok]
                np.add.at(n, a, copies[b])
                # a member that does not search the query's list is not going to find it
                late = ~searches[c, home[a]]
                np.add.at(n, b[late], copies[a[late]])
                up = _joined(up, np.minimum(a, b), np.maximum(a, b))
        has, child = np.flatnonzero(n), np.flatnonzero(up != np.arange(len(ids)))
        a = pa.array(np.concatenate([ids[has], ids[child]]))
        b = pa.array(np.concatenate([np.zeros(len(has), np.int64), ids[up[child]]]), mask=np.r_[np.ones(len(has), bool), np.zeros(len(child), bool)])
        return pa.table({"a": a, "b": b, "n": pa.array(np.concatenate([n[has], np.zeros(len(child), np.int64)]))})

    found = placed.select("d", "list", "m", "q", "member", "node", "copies", "home", "probes", "codes", "error", "v").groupBy("d", "list", "m", "q").applyInArrow(compare, schema)
    out = written(found, "links")
    drop_written(spark, size)
    return out


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, reach: float = REACH, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``."""
    spark = vectors.sparkSession
    rows = written(unit(vectors), "units")
    # identical vectors are searched as one
    one = rows.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("v").alias("v"))
    one = written(one, "vectors")
    found = links(one.select("node", "v", "copies"), threshold, reach, fit_rows)
    joined = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "jn")
    many = found.where("b is null").groupBy(F.col("a").alias("mn")).agg(F.sum("n").alias("n"))
    reps = one.select("node", "first", "copies").join(many, F.col("node") == F.col("mn"), "left").join(joined, F.col("node") == F.col("jn"), "left")
    reps = reps.select(F.col("node").alias("rn"), "first", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "node").alias("component"))
    reps = written(reps, "linked")
    least = reps.groupBy(F.col("component").alias("lc")).agg(F.min("first").alias("component_id"))
    reps_ = reps.join(least, F.col("component") == F.col("lc")).select("rn", "n", "component_id")
    for done in (one, found, joined):
        drop_written(spark, done)
    out = rows.select("vec_id", "node").join(reps_, F.col("node") == F.col("rn"), "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
