"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

Every block of documents is a reference block for all later text.  Its index holds
each distinct window of ``WINDOW`` words once, at its first place in the block, under
an *anchor*: the smallest hash among the window's runs of ``ANCHOR`` words.  Equal
windows have equal anchors, so one shuffle by anchor brings the blocks' indexes
together, and a window is a match if the same window starts earlier anywhere.  A
window that repeats inside its block is matched there and does not travel, so a
passage in a third of all documents costs one entry a block.

A document is then parsed greedily: consecutive matches with one alignment to one
reference document grow into a factor; where the alignment changes, the windows that
straddle the boundary were matched on their own and join the next factor.  Factors
are at least ``WINDOW`` words long, and what they cover is removed.

Windows are compared by a 64-bit hash of all their words, inside their bucket.  There is
``SPREAD`` buckets for every ``BUCKET_BYTES`` of text, so no group grows with the input.  A run
of words in more than ``HOT`` of all places (a line of a third of the documents) would
bring all windows around it to one bucket; the windows under such an anchor are dealt out
by their own hash.  A pass over all texts finds them: what has that share of all places
has it in some block, so blocks name candidates with their counts.  There are at most
``1 / HOT`` of them, which bounds the broadcast.

Edge cases: null texts and texts shorter than a window lose nothing; among rows with
one ``doc_id`` (null sorts first) order is by text digest, and of identical rows one
counts as the first; overlapping repeats inside a document count (a later start is a
repeat); a very long text is a block of its own; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import blocks, drop_written, freeing, n_parts, texts, written

WINDOW = 20
ANCHOR = 6
#: Bytes of text in a reference block.
REFERENCE_BYTES = 12 << 20
_BASE = 0x9E3779B97F4A7C15
_MIX = 0xD6E8FEB86659FD93
_ROW = pa.schema([("bucket", pa.int32()), ("data", pa.binary())])
#: Bytes of text whose windows a task matches, buckets that it has of them as a rule, so
#: that tasks are even, and share of all places that is hot.
BUCKET_BYTES, SPREAD = 16 << 20, 4
HOT = 2e-5
#: Bits of the counting table that finds hot runs in a block.
CELL_BITS = 20
_MATCH_DDL = "id long, none boolean, digest int, start int, many int, ref_doc long, ref_start int"
_MATCH = pa.schema([("id", pa.int64()), ("none", pa.bool_()), ("digest", pa.int32()), ("start", pa.int32()), ("many", pa.int32()), ("ref_doc", pa.int64()), ("ref_start", pa.int32())])
#: Arrays of an index row: entries (one per anchor and place), their windows, and
#: matches found inside the block.
_ENTRY = ("<i8", "u1", "<i4", "<i4", "<i4")
_KNOWN = ("<i8", "u1", "<i4", "<i4", "<i4", "<i8", "u1", "<i4")


def words(text: str) -> list[bytes]:
    """Runs of characters other than ASCII white space, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_MIX)
    return x ^ (x >> np.uint64(29))


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` values from each place on; shorter by ``k - 1``."""
    n = len(h) - k + 1
    out = h[:n].copy()
    for j in range(1, k):
        out *= np.uint64(_BASE)
        out += h[j : j + n]
    return _mixed(out)


def windows_of(h: np.ndarray, ends: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, window hash, anchor hash, anchor place) of each window inside a
    document; ``h`` holds the word hashes of documents that end at ``ends``."""
    n = len(h) - window + 1
    if n <= 0:
        return tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64))
    inside = np.ones(n, bool)
    for e in ends[:-1].tolist():
        inside[max(0, e - window + 1) : min(e, n)] = False
    full, gram = _grams(h, window), _grams(h, anchor)
    span = window - anchor + 1
    least, have = gram, 1
    while have < span:
        step = min(have, span - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    offset = np.zeros(n, np.int64)
    for d in range(span - 1, -1, -1):
        offset[gram[d : d + n] == least] = d
    start = np.flatnonzero(inside)
    return start, full[start], least[start], start + offset[start]


def _hashes(ts: list[str]) -> list[np.ndarray]:
    """Word hashes of each text."""
    w = [words(t) for t in ts]
    flat = np.empty(sum(map(len, w)), object)
    flat[:] = [x for d in w for x in d]
    h = pd.util.hash_array(flat, categorize=False) if len(flat) else np.empty(0, np.uint64)
    return np.split(h, np.cumsum([len(d) for d in w])[:-1])


def hot_runs(docs: DataFrame, anchor: int = ANCHOR, hot: float = HOT, reference_bytes: int = REFERENCE_BYTES) -> tuple[np.ndarray, int]:
    """(sorted hashes of runs of ``anchor`` words in at least twice ``hot`` of all places,
    and maybe some with half of that; bytes of all texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(size, parts):
            h = np.concatenate(parts)
            gram = _grams(h, anchor) if len(h) >= anchor else np.empty(0, np.uint64)
            cell = (gram >> np.uint64(64 - CELL_BITS)).astype(np.int64)
            least = max(2.0, hot * len(gram))
            own, many = np.unique(gram[np.bincount(cell, minlength=1 << CELL_BITS)[cell] >= least], return_counts=True)
            own, many = own[many >= least], many[many >= least]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.r_[own.view(np.int64), 0]), pa.array(np.r_[many, len(gram)], pa.int64()), pa.array([0] * len(own) + [size], pa.int64()), pa.array([True] * len(own) + [False])], names=["gram", "n", "bytes", "own"]
            )

        held, parts = 0, []
        for _, ts in blocks(batches):
            parts += _hashes(ts)
            held += sum(map(len, ts))
            if held >= reference_bytes:
                yield close(held, parts)
                held, parts = 0, []
        if parts:
            yield close(held, parts)

    made = texts(docs).mapInArrow(freeing(run), "gram long, n long, bytes long, own boolean").groupBy("own", "gram").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    made = written(made, "runs")
    whole = made.where("not own").agg(F.sum("n"), F.sum("bytes")).first()
    own = made.where("own").where(F.col("n") >= hot * (whole[0] or 0)).select("gram").toArrow().column("gram").to_numpy()
    drop_written(docs.sparkSession, made)
    return np.sort(own.astype(np.int64).view(np.uint64)), whole[1] or 0


def _rows(ids, null, digests, hashes, window: int, anchor: int, buckets: int, hot: np.ndarray = np.empty(0, np.uint64)) -> pa.RecordBatch:
    """Index rows of one reference block, one per bucket.

    An entry is a run of windows with one anchor and bucket, 64 bits a window; runs that
    only repeat earlier windows of the block go along as finished matches.
    """
    order = sorted(range(len(ids)), key=lambda i: (not null[i], ids[i], digests[i]))
    ids, digests, null = (np.array([x[i] for i in order]) for x in (ids, digests, null))
    hashes = [hashes[i] for i in order]
    ends = np.cumsum([len(x) for x in hashes])
    h = np.concatenate(hashes)
    start, full, least, place = windows_of(h, ends, window, anchor)
    doc = np.searchsorted(ends, start, side="right")
    first_of = np.concatenate([[0], ends[:-1]])
    _, at, back = np.unique(full, return_index=True, return_inverse=True)
    ref = at[back]
    own = ref == np.arange(len(start))
    if not len(start):
        return pa.RecordBatch.from_pydict({"bucket": [], "data": []}, schema=_ROW)
    to = (least % np.uint64(buckets)).astype(np.int32)
    if len(hot):
        own_hash = hot[np.minimum(np.searchsorted(hot, least), len(hot) - 1)] == least
        to[own_hash] = (full[own_hash] % np.uint64(buckets)).astype(np.int32)
    # runs of consecutive windows that share an anchor's place
    cut = np.flatnonzero(np.concatenate([[True], (to[1:] != to[:-1]) | (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1) | (doc[1:] != doc[:-1])]))
    many = np.diff(np.concatenate([cut, [len(start)]]))
    sent = np.add.reduceat(own, cut) > 0
    keep = np.repeat(sent, many)
    a, n = cut[sent], many[sent]
    value = full[keep]
    end = np.cumsum(n)
    bucket = to[a]
    order = np.argsort(bucket, kind="stable")
    present, at = np.unique(bucket[order], return_index=True)
    out: list[tuple[int, bytes]] = []
    for k, own_rows in zip(present.tolist(), np.split(order, at[1:]), strict=True):
        i, d = a[own_rows], doc[a[own_rows]]
        m = n[own_rows]
        windows = value[np.repeat(end[own_rows] - np.cumsum(m), m) + np.arange(m.sum())]
        out.append((k, _packed([np.diff(ids[d], prepend=0), null[d], digests[d], start[i] - first_of[d], m], _ENTRY, windows)))
    # windows in runs that are not sent: matches inside the block
    rest = np.flatnonzero(~keep)
    if len(rest):
        q = ref[rest]
        shift = start[q] - start[rest]
        new = np.concatenate([[True], (np.diff(rest) != 1) | (np.diff(shift) != 0) | (np.diff(start[rest]) != 1) | (np.diff(doc[rest]) != 0) | (np.diff(doc[q]) != 0)])
        b = rest[new]
        m = np.diff(np.concatenate([np.flatnonzero(new), [len(rest)]]))
        r = ref[b]
        d, e = doc[b], doc[r]
        out.append((int(digests[0]) % buckets, b"known" + _packed([ids[d], null[d], digests[d], start[b] - first_of[d], m, ids[e], null[e], start[r] - first_of[e]], _KNOWN)))
    return pa.RecordBatch.from_pydict({"bucket": [k for k, _ in out], "data": [x for _, x in out]}, schema=_ROW)


def _packed(columns: list[np.ndarray], kinds: tuple[str, ...], tail: np.ndarray | None = None) -> bytes:
    """Columns of equal length, compressed, then an array that is not."""
    raw = b"".join(c.astype(k).tobytes() for c, k in zip(columns, kinds, strict=True))
    z = pa.compress(raw, codec="zstd", asbytes=True)
    return np.array([len(columns[0]), len(raw), len(z)], "<u8").tobytes() + z + (b"" if tail is None else tail.tobytes())


def _unpacked(data: bytes, kinds: tuple[str, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    n, size, z = np.frombuffer(data, "<u8", 3).tolist()
    raw, at, out = pa.decompress(data[24 : 24 + z], size, codec="zstd", asbytes=True), 0, []
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out, np.frombuffer(data, "<u8", offset=24 + z)


def _index(window: int, anchor: int, reference_bytes: int, buckets: int, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = 0, ([], [], [], [])
        for part, ts in blocks(batches):
            size = sum(map(len, ts))
            if held and held + size > reference_bytes:
                yield _rows(*state, window, anchor, buckets, hot.value)
                held, state = 0, ([], [], [], [])
            ids, null, digests, hashes = state
            ids += part.column(0).to_pylist()
            null += part.column(2).to_pylist()
            digests += part.column(3).to_pylist()
            hashes += _hashes(ts)
            held += size
        if state[0]:
            yield _rows(*state, window, anchor, buckets, hot.value)

    return freeing(run)


def _match(table: pa.Table) -> pa.Table:
    """Matches among the index rows of one bucket, and those the blocks had found."""
    entries: list[list[np.ndarray]] = []
    tails: list[np.ndarray] = []
    done: list[list[np.ndarray]] = []
    for x in table.column("data"):
        data = x.as_py()
        if data[:5] == b"known":
            done.append(_unpacked(data[5:], _KNOWN)[0])
            continue
        cols, tail = _unpacked(data, _ENTRY)
        cols[0] = np.cumsum(cols[0])
        entries.append(cols)
        tails.append(tail)
    found = []
    if done:
        ids, null, digest, start, many, ref, no_ref, ref_start = (np.concatenate(c) for c in zip(*done, strict=True))
        found.append(pa.table([ids, null.astype(bool), digest, start, many, pa.array(ref, mask=no_ref.astype(bool)), ref_start], schema=_MATCH))
    if entries:
        ids, null, digest, start, many = (np.concatenate(c) for c in zip(*entries, strict=True))
        tail = np.concatenate(tails)
        begin = np.cumsum(many) - many
        # earlier places first: the first of equal windows is then the earliest
        order = np.lexsort((start, digest, ids, null == 0))
        ids, null, digest, start, many, begin = (x[order] for x in (ids, null, digest, start, many, begin))
        row = np.repeat(np.arange(len(many)), many)
        step = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        key = tail[begin[row] + step]
        _, at, back = np.unique(key, return_index=True, return_inverse=True)
        ref = at[back]
        hit = np.flatnonzero(ref != np.arange(len(key)))
        if len(hit):
            place = start[row] + step
            r, q = row[hit], row[ref[hit]]
            shift = place[ref[hit]] - place[hit]
            new = np.concatenate([[True], (np.diff(r) != 0) | (np.diff(hit) != 1) | (np.diff(q) != 0) | (np.diff(shift) != 0)])
            a = hit[new]
            d, e = row[a], row[ref[a]]
            n = np.diff(np.concatenate([np.flatnonzero(new), [len(hit)]]))
            found.append(pa.table([ids[d], null[d].astype(bool), digest[d], place[a].astype(np.int32), n.astype(np.int32), pa.array(ids[e], mask=null[e].astype(bool)), place[ref[a]].astype(np.int32)], schema=_MATCH))
    return pa.concat_tables(found) if found else _MATCH.empty_table()


def matches(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, reference_bytes: int = REFERENCE_BYTES, bucket_bytes: int = BUCKET_BYTES, hot: float = HOT) -> DataFrame:
    """(id, none, digest, start, many, ref_doc, ref_start): ``many`` consecutive windows
    of a document from word ``start`` on, that occur from ``ref_start`` of ``ref_doc``."""
    spark = docs.sparkSession
    often, size = hot_runs(docs, anchor, hot, reference_bytes)
    parts = max(n_parts(spark), -(-size // bucket_bytes))
    buckets = parts * SPREAD
    index = _digested(docs).mapInArrow(_index(window, anchor, reference_bytes, buckets, spark.sparkContext.broadcast(often)), "bucket int, data binary")
    return index.repartition(parts, "bucket").groupBy("bucket").applyInArrow(_match, _MATCH_DDL)


def _digested(docs: DataFrame) -> DataFrame:
    """(id, text, none, digest): rows without an id go by a hash of their text; 32 bits of
    digest tell rows of one id apart."""
    return texts(docs).select(F.coalesce("doc_id", F.xxhash64("text")).alias("id"), "text", F.col("doc_id").isNull().alias("none"), F.hash("text").alias("digest"))


def factors(found: list[dict], window: int = WINDOW) -> list[tuple[int, int, int | None, int]]:
    """Greedy parse: (start, end, ref_doc, ref_start) in words, by start."""
    out: list[list] = []
    for m in sorted(found, key=lambda m: (m["start"], -m["many"])):
        end = m["start"] + m["many"] + window - 1
        last = out[-1] if out else None
        if last and m["start"] <= last[1] - window + 1 and m["ref_doc"] == last[2] and m["ref_start"] - m["start"] == last[3] - last[0]:
            last[1] = max(last[1], end)
        else:
            out.append([m["start"], end, m["ref_doc"], m["ref_start"]])
    return [tuple(x) for x in out]


def dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, reference_bytes: int = REFERENCE_BYTES, bucket_bytes: int = BUCKET_BYTES, hot: float = HOT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, factors): documents without repeats.

    ``kept`` is the words that stay, joined by one space.
    """
    # one key for counting copies and for joining, so that texts are shuffled once
    key = ["id", "none", "digest"]
    found = matches(docs, window, anchor, reference_bytes, bucket_bytes, hot).select(*key, F.struct("start", "many", "ref_doc", "ref_start").alias("m"))
    found = found.groupBy(*key).agg(F.collect_list("m").alias("found"))
    one = Window.partitionBy(*key)
    rows = _digested(docs)
    rows = rows.withColumn("copy", F.row_number().over(one.orderBy("digest"))).withColumn("copies", F.count("*").over(one))
    rows = rows.join(found, key, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ts in blocks(batches):
            many, gone, kept, parsed = [], [], [], []
            for t, m, copy, copies in zip(ts, part.column(4).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                w = words(t)
                many.append(len(w))
                own = m or []
                if own and copies > 1:
                    # identical rows report together: what all report is no first place
                    times = np.zeros(len(w) + 1, np.int64)
                    for x in own:
                        times[x["start"]] += 1
                        times[x["start"] + x["many"]] -= 1
                    full = np.cumsum(times)[:-1] >= (copies if copy == 1 else 1)
                    own = [{**x, "start": x["start"] + k, "many": 1, "ref_start": x["ref_start"] + k} for x in own for k in range(x["many"]) if full[x["start"] + k]]
                spans = factors(own, window)
                left, at = [], 0
                for s, e, _, _ in spans:
                    left += w[at:s]
                    at = max(at, e)
                left += w[at:]
                gone.append(len(w) - len(left))
                kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
                parsed.append([{"start": s, "end": e, "ref_doc": d, "ref_start": r} for s, e, d, r in spans])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(many, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(parsed, _FACTORS)], names=["doc_id", "n_words", "n_removed", "kept", "factors"])

    doc = F.when(~F.col("none"), F.col("id")).alias("doc_id")
    return rows.select(doc, "text", "copy", "copies", "found").mapInArrow(freeing(run), "doc_id long, n_words long, n_removed long, kept string, factors array<struct<start:int,end:int,ref_doc:long,ref_start:int>>")


_FACTORS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("ref_doc", pa.int64()), ("ref_start", pa.int32())]))
