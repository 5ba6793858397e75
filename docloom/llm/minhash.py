"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles.

A shingle is five consecutive words (ASCII-lower-cased runs of letters and digits).  Its
weight in a document is its count times an inverse document frequency between 1 and 2,
``1 + min(1, ln(N / df) / ln(1 / COMMON))`` in steps of 1/15: 2 for what fewer than
``COMMON`` of all documents hold, down to 1 for what all hold.  So text shared by a large
group of copies still counts.  Frequencies of common shingles are exact: a shingle that
is common at all is common in some block of documents, so blocks name candidates, and a
second pass counts those.  There are at most ``1 / COMMON`` times the average length of
them, which bounds the broadcast; candidates travel as a bitmap of fixed size.

Documents with the same words are one node.  ``BANDS * ROWS`` samples per node, each a
shingle drawn in proportion to weight, consistent between documents; ``ROWS`` of them
make a bucket key.  Pairs that share a bucket are candidates, and every candidate that
could join two classes is verified by the weighted Jaccard similarity of whole texts:

1. every member against its bucket's leader, the member that has most company over all
   its buckets (the original of a group of copies, as a rule), each pair once;
2. in buckets whose members are then in different classes, those outside the largest
   class against each other and against the largest class.  Buckets with the same
   members are taken once.  Members are cut into chunks of ``CHUNK_BYTES`` and
   ``CHUNK_ROWS``, and two chunks are one group, compared in one matrix product, so no
   group grows with its bucket.

No candidate is dropped by sketches, caps or bucket size.  Classes are the connected
components of verified links.  At similarity 0.8 a pair meets in some bucket with
probability 0.995, at 0.85 with 0.9994.

Edge cases: null texts and texts without words are in classes of their own; shorter
texts than a shingle are one shingle of all their words; rows with a null id link with
nothing; rows that share an id are judged each by its own text, and a class goes by its
smallest id; very long texts are one vector of four bytes and a byte per shingle; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import blocks, drop_written, freeing, texts, written
from docloom.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 10, 4
#: Share of documents from which on a shingle is common and weighs less.
COMMON = 0.01
#: Steps of the weight between 1 and 2.
STEPS = 15
#: Bits of the bitmap of candidates, as a power of two, and bytes of text in a block.
CELL_BITS = 20
BLOCK_BYTES = 8 << 20
#: Most bytes of vectors, and most of them, in a chunk of a bucket.
CHUNK_BYTES, CHUNK_ROWS = 4 << 20, 2048
#: Pairs of a leader, and members of a bucket, that one key of a shuffle holds.
LEADER_ROWS = 4096
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_MIX)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_MIX)
    return x ^ (x >> np.uint64(32))


#: A-Z as a-z, and 0 for ASCII that is no letter or digit.
_FOLD = np.array([c if chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" or c > 127 else c + 32 if 65 <= c <= 90 else 0 for c in range(256)], np.uint8)
_LETTER = np.random.default_rng(17).integers(1, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(ts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, words per text), without a Python object per word."""
    raw = [t.encode("utf-8", "surrogatepass") for t in ts]
    c = _FOLD[np.frombuffer(b" ".join([*raw, b""]), np.uint8)]
    inside = c != 0
    start = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    end = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    if not len(start):
        return np.empty(0, np.uint64), np.zeros(len(ts), np.int64)
    # place in its word of every letter; the sum over a word of letter times power of place
    at = np.flatnonzero(inside)
    size = end - start
    place = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(size.max()) - 1, _BASE, np.uint64)]))
    h = np.add.reduceat(_LETTER[c[at]] * power[place], np.cumsum(size) - size)
    bounds = np.cumsum([len(r) + 1 for r in raw])
    return _mixed(h), np.diff(np.searchsorted(start, bounds), prepend=0)


def shingles(ts: list[str]) -> list[tuple[np.ndarray, np.ndarray, int | None]]:
    """(distinct shingle hashes, counts, node) of each text; a node is 64 bits that stand
    for a sequence of words, None if there are none."""
    h, many = word_hashes(ts)
    out, at = [], 0
    n = max(0, len(h) - SHINGLE + 1)
    gram = h[:n].copy()
    for j in range(1, SHINGLE):
        gram *= np.uint64(_BASE)
        gram += h[j : j + n]
    gram = _mixed(gram)
    for size in many.tolist():
        own = h[at : at + size]
        if not size:
            out.append((np.empty(0, np.uint64), np.empty(0, np.int64), None))
            continue
        node = int.from_bytes(hashlib.md5(own.tobytes(), usedforsecurity=False).digest()[:8], "little", signed=True)
        if size < SHINGLE:
            one = size
            for x in own.tolist():
                one = (one * _BASE + x) & 0xFFFFFFFFFFFFFFFF
            out.append((_mixed(np.array([one], np.uint64)), np.ones(1, np.int64), node))
        else:
            out.append((*np.unique(gram[at : at + size - SHINGLE + 1], return_counts=True), node))
        at += size
    return out


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _hashed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, list[int | None], np.ndarray]]:
    """(ids, nodes, distinct shingles of each document in a row) of ``most`` bytes of text
    at a time."""
    held, ids, nodes, h = 0, [], [], []
    for part, ts in blocks(batches):
        ids += part.column(0).to_pylist()
        for x, _, node in shingles(ts):
            h.append(x), nodes.append(node)
        held += sum(map(len, ts))
        if held >= most:
            yield ids, nodes, np.concatenate(h)
            held, ids, nodes, h = 0, [], [], []
    if ids:
        yield ids, nodes, np.concatenate(h)


def nodes_and_candidates(docs: DataFrame, common: float = COMMON, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Written rows (doc_id, node, cell): one per document, and one with ``cell`` per
    block and cell that holds a shingle common in that block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, nodes, h in _hashed(batches, block_bytes):
            least = common * sum(x is not None for x in nodes)
            cell = _cell(h)
            own = h[np.bincount(cell, minlength=1 << CELL_BITS)[cell] >= least]
            own, many = np.unique(own, return_counts=True)
            cell = np.unique(_cell(own[many >= least]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids + [None] * len(cell), pa.int64()), pa.array(nodes + [None] * len(cell), pa.int64()), pa.array([None] * len(ids) + cell.tolist(), pa.int32())],
                names=["doc_id", "node", "cell"],
            )

    return written(texts(docs).mapInArrow(freeing(run), "doc_id long, node long, cell int"), "nodes")


class Weights:
    """Inverse document frequencies, as steps above 1; ``grams`` are sorted."""

    def __init__(self, grams: np.ndarray, steps: np.ndarray):
        self.grams, self.steps = grams, steps
        self.cells = np.zeros(1 << CELL_BITS, bool)
        self.cells[_cell(grams)] = True

    def of(self, h: np.ndarray) -> np.ndarray:
        """Steps of shingles: ``STEPS`` but for common ones."""
        out = np.full(len(h), STEPS, np.uint8)
        if len(self.grams):
            own = np.flatnonzero(self.cells[_cell(h)])
            at = np.minimum(np.searchsorted(self.grams, h[own]), len(self.grams) - 1)
            hit = self.grams[at] == h[own]
            out[own[hit]] = self.steps[at[hit]]
        return out


def weights(docs: DataFrame, made: DataFrame, common: float = COMMON, block_bytes: int = BLOCK_BYTES) -> Weights:
    """Exact document frequencies of all shingles in at least ``common`` of documents."""
    n = made.where("node is not null").count()
    cells = np.zeros(1 << CELL_BITS, bool)
    cells[[r.cell for r in made.where("cell is not null").select("cell").distinct().collect()]] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(cells))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(shared.value).astype(bool)
        for _, _, h in _hashed(batches, block_bytes):
            gram, many = np.unique(h[wanted[_cell(h)]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(many, pa.int64())], names=["gram", "n"])

    if not n or not cells.any():
        return Weights(np.empty(0, np.uint64), np.empty(0, np.uint8))
    counted = texts(docs).mapInArrow(freeing(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    rows = counted.where(F.col("n") >= common * n).toArrow()
    grams, df = rows.column("gram").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(grams)
    steps = np.round(STEPS * np.clip(np.log(n / df) / math.log(1 / common), 0, 1)).astype(np.uint8)
    return Weights(grams[order], steps[order])


def gamma_quantiles(n: int = 1 << 16) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of n equal steps, by bisection."""
    p = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 60.0)
    for _ in range(60):
        x = (low + high) / 2
        under = 1 - np.exp(-x) * (1 + x) < p
        low, high = np.where(under, x, low), np.where(under, high, x)
    return ((low + high) / 2).astype(np.float32)


def samples(h: np.ndarray, weight: np.ndarray, starts: np.ndarray, r_of: np.ndarray) -> np.ndarray:
    """Consistent weighted samples [document, sample] as 64-bit hashes.

    ``starts``: where each document's shingles begin; none is empty.  For shingle x and
    sample k, r and c are Gamma(2, 1), b uniform, all functions of (x, k); with
    t = floor(ln w / r + b) the shingle of least ln c - r (t - b + 1) is drawn with t.
    """
    log_c = np.log(r_of)
    log_w = np.log(weight).astype(np.float32)
    size = np.diff(np.append(starts, len(h)))
    out = np.empty((len(starts), BANDS * ROWS), np.uint64)
    low16, step = np.uint64(0xFFFF), np.float32(1 / 65536)
    for k in range(BANDS * ROWS):
        u = _mixed(h + np.uint64((k + 1) * _BASE & 0xFFFFFFFFFFFFFFFF))
        r = r_of[(u & low16).astype(np.int32)]
        b = ((u >> np.uint64(16)) & low16).astype(np.float32) * step
        t = np.floor(log_w / r + b)
        a = log_c[((u >> np.uint64(32)) & low16).astype(np.int32)] - r * (t - b + 1)
        least = np.minimum.reduceat(a, starts)
        hit = np.flatnonzero(a == np.repeat(least, size))
        first = hit[np.searchsorted(hit, starts)]
        out[:, k] = _mixed(h[first] ^ (t[first].astype(np.int64).astype(np.uint64) * np.uint64(_BASE)))
    return out


def sketches(docs: DataFrame, idf: Weights) -> DataFrame:
    """(node, b0, b1, ...): bucket keys of every document with words."""
    shared = docs.sparkSession.sparkContext.broadcast((idf.grams, idf.steps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r_of, idf = gamma_quantiles(), Weights(*shared.value)
        for _, ts in blocks(batches, 1 << 20):
            each = {node: (h, n) for h, n, node in shingles(ts) if node is not None}
            if not each:
                continue
            h = np.concatenate([x for x, _ in each.values()])
            tf = np.concatenate([x for _, x in each.values()])
            starts = np.concatenate([[0], np.cumsum([len(x) for x, _ in each.values()])[:-1]]).astype(np.int64)
            band = samples(h, tf * (1 + idf.of(h) / STEPS), starts, r_of).reshape(len(each), BANDS, ROWS)
            key = band[:, :, 0].copy()
            for j in range(1, ROWS):
                key = _mixed(key * np.uint64(_BASE) + band[:, :, j])
            yield pa.RecordBatch.from_arrays([pa.array(list(each), pa.int64()), *(pa.array(key[:, k].view(np.int64)) for k in range(BANDS))], names=_SKETCH)

    made = texts(docs).where("doc_id is not null").mapInArrow(freeing(run), ", ".join(f"{c} long" for c in _SKETCH))
    return made.groupBy("node").agg(*[F.first(c).alias(c) for c in _SKETCH[1:]])


_SKETCH = ["node", *(f"b{k}" for k in range(BANDS))]


def vector(h: np.ndarray, n: np.ndarray, idf: Weights) -> bytes:
    """Sorted 32-bit features and their weight steps; the k-th occurrence of a shingle
    is a feature of its own, so similarity is of sets with weights."""
    steps = np.repeat(idf.of(h), n)
    again = np.repeat(h, n)
    k = np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)
    feature = (_mixed(again + k.astype(np.uint64) * np.uint64(_BASE)) >> np.uint64(32)).astype(np.uint32)
    feature, at = np.unique(feature, return_index=True)
    return feature.astype("<u4").tobytes() + steps[at].tobytes()


def opened(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(features, weights) of a ``vector``."""
    n = len(data) // 5
    return np.frombuffer(data, "<u4", n), 1 + np.frombuffer(data, "u1", n, 4 * n) / STEPS


def bodies(docs: DataFrame, wanted: DataFrame, idf: Weights) -> DataFrame:
    """(node, vec, size) of the documents whose id is in ``wanted`` (own)."""
    shared = docs.sparkSession.sparkContext.broadcast((idf.grams, idf.steps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = Weights(*shared.value)
        for _, ts in blocks(batches):
            each = shingles(ts)
            vec = [vector(h, n, idf) for h, n, _ in each]
            yield pa.RecordBatch.from_arrays([pa.array([node for _, _, node in each], pa.int64()), pa.array(vec, pa.binary()), pa.array(map(len, vec), pa.int64())], names=["node", "vec", "size"])

    rows = texts(docs)
    rows = rows.join(wanted, rows["doc_id"] == wanted["own"], "left_semi").groupBy("doc_id", "text").agg(F.lit(1).alias("one"))
    return rows.select("doc_id", "text").mapInArrow(freeing(run), "node long, vec binary, size long").where("node is not null")


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of common weights over sum of all weights of (sorted features, weights)."""
    _, i, _ = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(a[1][i].sum())
    every = float(a[1].sum() + b[1].sum()) - both
    return both / every if every else 0.0


def verified(star: DataFrame, body: DataFrame, threshold: float) -> DataFrame:
    """(a, b): the pairs (lead, node) of ``star`` whose texts are similar enough.

    A leader's vector stands before those of its members, once for each of its ``parts``,
    so that a task holds one vector and a leader of a third of all texts is many tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            a, b = [], []
            for lead, node, vec in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if node is None:
                    left = opened(vec.as_py())
                elif weighted_jaccard(left, opened(vec.as_py())) >= threshold - 1e-9:
                    a.append(max(lead, node)), b.append(min(lead, node))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    vec = body.select(F.col("node").alias("vn"), "vec")
    own = star.join(vec, F.col("node") == F.col("vn")).select("lead", F.pmod(F.xxhash64("node"), "parts").alias("part"), "node", "vec")
    first = star.groupBy("lead").agg(F.max("parts").alias("parts")).join(vec, F.col("lead") == F.col("vn"))
    first = first.select("lead", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("node"), "vec")
    rows = first.unionByName(own).repartition("lead", "part").sortWithinPartitions("lead", "part", F.col("node").asc_nulls_first())
    return rows.select("lead", "node", "vec").mapInArrow(freeing(run), "a long, b long")


def stars(member: DataFrame, most: int = LEADER_ROWS) -> DataFrame:
    """(lead, node, parts): every member of a bucket with its leader, the member that has
    most company over all its buckets; each pair once.

    A leader's pairs are at most its company, and ``parts`` as many as make ``most`` pairs
    each.  Buckets meet their leaders in parts of ``most`` members."""
    company = member.groupBy("node").agg(F.sum("n").alias("company")).withColumnRenamed("node", "cn")
    rows = member.join(company, member["node"] == company["cn"])
    lead = rows.groupBy("band", "at").agg(F.max(F.struct("company", "node")).alias("m"), F.max("n").alias("n"))
    cut = lambda n: F.ceil(n / most).cast("long")
    lead = lead.select(F.col("band").alias("lb"), F.col("at").alias("la"), F.col("m.node").alias("lead"), cut(F.col("m.company")).alias("parts"), F.explode(F.sequence(F.lit(0).cast("long"), cut(F.col("n")) - 1)).alias("ls"))
    rows = member.withColumn("salt", F.pmod(F.xxhash64("node"), cut(F.col("n"))))
    rows = rows.join(lead, (F.col("band") == F.col("lb")) & (F.col("at") == F.col("la")) & (F.col("salt") == F.col("ls"))).where("node <> lead")
    # two leaders may have each other as members
    rows = rows.groupBy(F.greatest("node", "lead").alias("a"), F.least("node", "lead").alias("b")).agg(F.max(F.struct("parts", "lead")).alias("m"))
    return rows.select(F.col("m.lead").alias("lead"), F.when(F.col("a") == F.col("m.lead"), F.col("b")).otherwise(F.col("a")).alias("node"), F.col("m.parts").alias("parts"))


def _similar(vecs: list[bytes], rows: np.ndarray, columns: np.ndarray, threshold: float) -> np.ndarray:
    """[row, column]: whether two vectors are similar enough, from one sparse product
    that is made dense a thousand features at a time."""
    each = [opened(v) for v in vecs]
    owner = np.repeat(np.arange(len(each)), [len(f) for f, _ in each])
    total = np.array([w.sum() for _, w in each])
    _, first, place, many = np.unique(np.concatenate([f for f, _ in each]), return_index=True, return_inverse=True, return_counts=True)
    weight = np.concatenate([w for _, w in each])
    often = np.flatnonzero(many > 1)
    column = np.full(len(many), -1)
    column[often] = np.arange(len(often))
    at, cost = column[place], weight[first[often]].astype(np.float32)
    del each, place, column, weight
    order = np.argsort(at, kind="stable")
    order = order[np.searchsorted(at[order], 0) :]
    at, owner = at[order], owner[order]
    common = np.zeros((len(rows), len(columns)), np.float32)
    for a in range(0, len(often), 1024):
        own = slice(np.searchsorted(at, a), np.searchsorted(at, a + 1024))
        block = np.zeros((len(vecs), min(1024, len(often) - a)), np.float32)
        block[owner[own], at[own] - a] = 1.0
        common += (block[rows] * cost[a : a + 1024]) @ block[columns].T
    every = total[rows][:, None] + total[columns][None, :] - common
    return common >= threshold * every - 1e-3


def between_classes(known: DataFrame, body: DataFrame, threshold: float, chunk_bytes: int = CHUNK_BYTES, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(a, b): links that join different classes inside a bucket.

    ``known``: (band, at, node, class).  The members of the bucket's largest class are cut
    into chunks, and so are the others; every two chunks but two of the largest class are
    one group, and of the links found there those are given out that join classes not yet
    joined in the group.
    """
    sized = body.select(F.col("node").alias("sn"), "size")
    rows = known.join(sized, F.col("node") == F.col("sn")).select("band", "at", "node", "class", "size")
    rows = mixed = written(rows, "mixed")
    part = rows.groupBy("band", "at", "class").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    part = part.groupBy("band", "at").agg(F.max(F.struct("n", "class", "bytes")).alias("main"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    cut = lambda n, size: F.greatest(F.lit(1), F.ceil(n / chunk_rows), F.ceil(size / chunk_bytes)).cast("int")
    # buckets of the same members are compared once
    plan = part.where("n > main.n").groupBy("x", "y", "n").agg(F.min(F.struct("band", "at", "main", "bytes")).alias("b"))
    plan = plan.select(F.col("b.band").alias("pb"), F.col("b.at").alias("pa"), F.col("b.main.class").alias("main"), cut(F.col("b.main.n"), F.col("b.main.bytes")).alias("mc"), cut(F.col("n") - F.col("b.main.n"), F.col("b.bytes") - F.col("b.main.bytes")).alias("oc"))
    rows = rows.join(plan, (rows["band"] == plan["pb"]) & (rows["at"] == plan["pa"]))
    spread = lambda n: F.pmod(F.xxhash64("node", F.lit(2)), n).cast("int")
    rows = rows.withColumn("own", F.when(F.col("class") == F.col("main"), spread(F.col("mc"))).otherwise(F.col("mc") + spread(F.col("oc"))))
    low = F.when(F.col("class") == F.col("main"), F.col("mc")).otherwise(F.lit(0))
    rows = rows.withColumn("other", F.explode(F.sequence(low, F.col("mc") + F.col("oc") - 1)))
    vec = body.select(F.col("node").alias("bn"), "vec")
    rows = rows.join(vec, F.col("node") == F.col("bn"))
    rows = rows.select("band", "at", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "class", (F.col("own") > F.col("other")).alias("right"), "vec")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        node, cls, right = (table.column(c).to_numpy() for c in ("node", "class", "right"))
        x = y = np.arange(len(node))
        if key[2].as_py() != key[3].as_py():
            x, y = np.flatnonzero(~right), np.flatnonzero(right)
        a, b = [], []
        if len(x) and len(y):
            vecs = table.column("vec").to_pylist()
            near = _similar(vecs, x, y, threshold) & (cls[x][:, None] != cls[y][None, :])
            up = {c: c for c in cls.tolist()}

            def top(c: int) -> int:
                while up[c] != c:
                    up[c] = up[up[c]]
                    c = up[c]
                return c

            for i, j in zip(*np.nonzero(near), strict=True):
                i, j = int(x[i]), int(y[j])
                p, q = top(int(cls[i])), top(int(cls[j]))
                # the product is of single precision
                if p != q and weighted_jaccard(opened(vecs[i]), opened(vecs[j])) >= threshold - 1e-9:
                    up[max(p, q)] = min(p, q)
                    a.append(node[i])
                    b.append(node[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    out = written(rows.groupBy("band", "at", "i", "j").applyInArrow(compare, "a long, b long"), "verified")
    drop_written(known.sparkSession, mixed)
    return out


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, common: float = COMMON) -> DataFrame:
    """(doc_id, class_id, kept) for every row; ``class_id`` is the class's smallest id."""
    spark = docs.sparkSession
    made = nodes_and_candidates(docs, common)
    idf = weights(docs, made, common)
    keyed = made.where("cell is null").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node"))
    exact = keyed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"))

    sketch = written(sketches(docs, idf), "sketches")
    band = F.posexplode(F.array(*_SKETCH[1:])).alias("band", "at")
    member = sketch.select("node", band)
    size = member.groupBy("band", "at").agg(F.count("*").alias("n")).where("n > 1").select(F.col("band").alias("zb"), F.col("at").alias("za"), "n")
    member = written(member.join(size, (F.col("band") == F.col("zb")) & (F.col("at") == F.col("za"))).select("band", "at", "n", "node"), "buckets")
    drop_written(spark, sketch)
    own = exact.withColumnRenamed("node", "en").join(member.select("node").distinct(), F.col("en") == F.col("node")).select(F.col("first").alias("own"))
    body = written(bodies(docs, own, idf), "bodies")

    star = written(stars(member), "star")
    links = written(verified(star, body, threshold), "verified")
    drop_written(spark, star)
    part = components(links).select(F.col("node").alias("pn"), "component")
    # a bucket of two has been decided above
    known = member.where("n > 2").join(part, F.col("node") == F.col("pn"), "left").select("band", "at", "node", F.coalesce("component", "node").alias("class"))
    more = between_classes(known, body, threshold)
    classes = components(links.unionByName(more)).select(F.col("node").alias("cn"), "component")
    for done in (body, member, links, more, part):
        drop_written(spark, done)

    whole = exact.join(classes, F.col("node") == F.col("cn"), "left").select(F.col("node").alias("wn"), "first", F.coalesce("component", "node").alias("class"))
    least = whole.groupBy(F.col("class").alias("lc")).agg(F.min("first").alias("class_id"))
    whole = whole.join(least, F.col("class") == F.col("lc")).select("wn", "class_id")
    out = keyed.join(whole, F.col("node") == F.col("wn"), "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))
