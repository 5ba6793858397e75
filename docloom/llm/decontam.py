"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` stores, for every block of training documents, the positions of
each test term in the block's token stream (one posting list per term).  ``search``
takes each test phrase, orders its terms by how short their lists in the block are,
subtracts each term's offset in the phrase from its list, and intersects from the
rarest on; what is left after the last term are the exact phrase starts.
For proximity the same lists tell where all terms of a phrase, in any order, lie within
``WITHIN`` words of its first one.

The index is cut by documents, so intersection needs no shuffle and no key gathers
rows: a passage in a third of all documents is a long list in each block.  Test
phrases are cut into blocks of at most ``PHRASE_BYTES`` (measured, not assumed) and
only one block is broadcast at a time; more of them mean more passes.

Edge cases: null texts have no words; a document shorter than every phrase is never
hit; items with no words have no phrases; items with a null id are left out; an item
id that occurs twice is one item; null and repeated ``doc_id`` keep their own rows;
phrases never match across documents; very long texts are index blocks of their own;
extra columns are ignored; empty tables give no rows or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import blocks, freeing, texts, written

WINDOW = 10
WITHIN = 20
#: Most bytes of test phrases that are broadcast at once.
PHRASE_BYTES = 8 << 20
#: Bytes of text in an index block.
INDEX_BYTES = 16 << 20
#: Lower-cases A-Z and turns what is no word character into a space, on UTF-8.
_TABLE = bytes(c if chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def phrases(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, phrase): every window of every item, words joined by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ts in blocks(batches):
            ids, out = [], []
            for i, t in zip(part.column(0).to_pylist(), ts, strict=True):
                w = words(t)
                found = {b" ".join(w[k : k + window]) for k in range(max(1, len(w) - window + 1))} if w else ()
                out += found
                ids += [i] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["item_id", "phrase"])

    items = texts(benchmark, "item_id").where("doc_id is not null")
    return items.mapInArrow(run, "item_id long, phrase binary").distinct()


def phrase_blocks(found: DataFrame, most: int = PHRASE_BYTES) -> Iterator[tuple[list[bytes], list[list[int]]]]:
    """(phrases, items of each) in blocks whose measured size is ``most`` at most."""
    sized = found.groupBy("phrase").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    sized = written(sized.withColumn("bytes", F.octet_length("phrase") + 8 * F.size("items") + 64), "phrases")
    total, largest = sized.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("bytes"), F.lit(0))).first()
    # a phrase goes with all its items
    most = max(most, largest)
    passes = -(-2 * total // most) if total > most else 1
    part = F.pmod(F.xxhash64("phrase"), F.lit(passes))
    while passes > 1 and sized.groupBy(part.alias("k")).agg(F.sum("bytes").alias("n")).agg(F.max("n")).first()[0] > most:
        passes *= 2
        part = F.pmod(F.xxhash64("phrase"), F.lit(passes))
    for k in range(passes):
        rows = sized.where(F.pmod(F.xxhash64("phrase"), F.lit(passes)) == k).orderBy("phrase").collect()
        yield [bytes(r.phrase) for r in rows], [list(r["items"]) for r in rows]


def build_index(docs: DataFrame, terms: set[bytes]) -> DataFrame:
    """One row per block of documents: (data), the postings of ``terms`` in it.

    The layout is numpy arrays, compressed: document ids, null flags, text digests
    and word counts, the terms that occur, list lengths, and positions as differences.
    """
    numbers = {t: i for i, t in enumerate(sorted(terms))}
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        kind = np.uint16 if len(number) < 65_535 else np.uint32
        none = len(number)

        def close(ids, null, digests, sizes, at):
            term = np.concatenate(at) if at else np.empty(0, kind)
            where = np.flatnonzero(term != none)
            order = where[np.argsort(term[where], kind="stable")]
            present, many = np.unique(term[order], return_counts=True)
            data = _pack(np.array(ids, "<i8"), np.array(null, "u1"), np.array(digests, "<i8"), np.array(sizes, "<u4"), present.astype("<u4"), many.astype("<u4"), np.diff(order, prepend=0).astype("<i4"))
            return pa.RecordBatch.from_pydict({"data": [data]}, schema=pa.schema([("data", pa.binary())]))

        held, state = 0, ([], [], [], [], [])
        for part, ts in blocks(batches):
            size = sum(map(len, ts))
            if held and held + size > INDEX_BYTES:
                yield close(*state)
                held, state = 0, ([], [], [], [], [])
            ids, null, digests, sizes, at = state
            digests += part.column(2).to_pylist()
            for d, t in zip(part.column(0).to_pylist(), ts, strict=True):
                w = words(t)
                at.append(np.fromiter([number.get(x, none) for x in w], kind, len(w)))
                ids.append(d or 0), null.append(d is None), sizes.append(len(w))
            held += size
        if state[0]:
            yield close(*state)

    return texts(docs).withColumn("digest", F.xxhash64("text")).mapInArrow(freeing(run), "data binary")


def _pack(*arrays: np.ndarray) -> bytes:
    z = [(len(a.tobytes()), pa.compress(a.tobytes(), codec="zstd", asbytes=True) if a.size else b"") for a in arrays]
    return b"".join([np.array([x for n, b in z for x in (n, len(b))], "<u8").tobytes(), *(b for _, b in z)])


def _unpack(data: bytes) -> list[np.ndarray]:
    kinds = ("<i8", "u1", "<i8", "<u4", "<u4", "<u4", "<i4")
    head, at, out = np.frombuffer(data, "<u8", 2 * len(kinds)).tolist(), 16 * len(kinds), []
    for kind, size, z in zip(kinds, head[::2], head[1::2], strict=True):
        out.append(np.frombuffer(pa.decompress(data[at : at + z], size, codec="zstd") if size else b"", kind))
        at += z
    return out


class Postings:
    """Posting lists of one index block."""

    def __init__(self, data: bytes):
        ids, null, self.digests, self.sizes, present, many, steps = _unpack(data)
        self.ids = [None if n else int(i) for i, n in zip(ids, null, strict=True)]
        self.bounds = np.concatenate([[0], np.cumsum(self.sizes.astype(np.int64))])
        ends = np.cumsum(many)
        self.positions = np.cumsum(steps.astype(np.int64))
        self.holders: dict[int, np.ndarray] = {}
        self.lists = {int(t): (int(e - n), int(e)) for t, n, e in zip(present, many, ends, strict=True)}

    def of(self, term: int) -> np.ndarray:
        a, b = self.lists.get(term, (0, 0))
        return self.positions[a:b]

    def count(self, term: int) -> int:
        a, b = self.lists.get(term, (0, 0))
        return b - a

    def doc(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, position, side="right") - 1

    def exact(self, phrase: list[int]) -> np.ndarray:
        """Positions where the terms of ``phrase`` stand one after another."""
        if not all(t in self.lists for t in phrase):
            return np.empty(0, np.int64)
        order = sorted(range(len(phrase)), key=lambda k: self.count(phrase[k]))
        left = self.of(phrase[order[0]]) - order[0]
        for k in order[1:]:
            if not len(left):
                break
            other = self.of(phrase[k])
            spot = np.searchsorted(other, left + k)
            left = left[other[np.minimum(spot, len(other) - 1)] == left + k]
        left = left[left >= 0]
        return left[self.doc(left) == self.doc(left + len(phrase) - 1)] if len(left) else left

    def documents(self, term: int) -> np.ndarray:
        """Documents that hold a term, in order."""
        if term not in self.holders:
            self.holders[term] = np.unique(self.doc(self.of(term)))
        return self.holders[term]

    def together(self, terms: list[int], without: np.ndarray) -> np.ndarray:
        """Documents that hold all terms, from the term in the fewest on, but for ``without``."""
        order = sorted(set(terms), key=self.count)
        left = self.documents(order[0])
        for t in order[1:]:
            if not len(left):
                return left
            left = left[np.isin(left, self.documents(t), assume_unique=True)]
        return left[~np.isin(left, without)] if len(left) and len(without) else left

    def near(self, terms: list[int], within: int, only: np.ndarray | None = None) -> np.ndarray:
        """Positions of the first term with every other at most ``within`` away, cut down
        from the rarest term on; with ``only`` in these documents."""
        left, others = self.of(terms[0]), sorted(set(terms) - {terms[0]}, key=self.count)
        if only is not None:
            left = left[np.isin(self.doc(left), only)]
        if others and self.count(others[0]) < len(left):
            # only first terms near the rarest one
            rare = self.of(others[0])
            a, b = np.searchsorted(left, rare - within), np.searchsorted(left, rare + within, side="right")
            many = b - a
            left = np.unique(left[np.repeat(a, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)])
        for t in others:
            other = self.of(t)
            if not len(left) or not len(other):
                return left[:0]
            after = np.searchsorted(other, left)
            ok = np.zeros(len(left), bool)
            for spot in (after - 1, np.minimum(after, len(other) - 1)):
                x = other[spot]
                ok |= (spot >= 0) & (np.abs(x - left) <= within) & (self.doc(x) == self.doc(left))
            left = left[ok]
        return left


def search(index: DataFrame, test: list[bytes], terms: set[bytes], within: int | None = None, also: int | None = None, items: list[list[int]] | None = None) -> DataFrame:
    """Rows (doc_id, digest, n_words, starts, phrase, near) per document: exact starts, or
    with ``within`` the proximity matches, as positions in the document; with ``also``
    phrases that match within so many words as well, in ``near``: enough of them to name
    every item of ``items`` (the items of each phrase) that has one."""
    numbers = {t: i for i, t in enumerate(sorted(terms))}
    lists = [[numbers[w] for w in p.split(b" ")] for p in test]
    shared = index.sparkSession.sparkContext.broadcast((lists, items or [[k] for k in range(len(lists))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test_lists, of = shared.value
        for batch in batches:
            for data in batch.column(0):
                p = Postings(data.as_py())
                starts: list[list[int]] = [[] for _ in p.ids]
                which: list[list[int]] = [[] for _ in p.ids]
                near: list[list[int]] = [[] for _ in p.ids]
                hit: dict[int, set[int]] = {}
                for k, phrase in enumerate(test_lists):
                    at = p.exact(phrase) if within is None else p.near(phrase, within)
                    if len(at):
                        for d, x in zip(p.doc(at).tolist(), at.tolist(), strict=True):
                            starts[d].append(x - int(p.bounds[d]))
                            which[d].append(k)
                            if also is not None:
                                near[d].append(k)
                                for item in of[k]:
                                    hit.setdefault(item, set()).add(d)
                for k, phrase in enumerate(test_lists if also is not None else ()):
                    if all(t in p.lists for t in phrase):
                        # an exact match is near; what all of the phrase's items have is known
                        known = set.intersection(*(hit.get(item, set()) for item in of[k])) if of[k] else set()
                        some = p.together(phrase, np.array(sorted(known), np.int64))
                        if len(some):
                            for d in np.unique(p.doc(p.near(phrase, also, some))).tolist():
                                near[d].append(k)
                                for item in of[k]:
                                    hit.setdefault(item, set()).add(d)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p.ids, pa.int64()), pa.array(p.digests, pa.int64()), pa.array(p.sizes, pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(which, pa.list_(pa.int32())), pa.array(near, pa.list_(pa.int32()))],
                    names=["doc_id", "digest", "n_words", "starts", "phrase", "near"],
                )

    return index.mapInArrow(freeing(run), "doc_id long, digest long, n_words long, starts array<long>, phrase array<int>, near array<int>")


def _report(found: DataFrame, test: list[bytes], items: list[list[int]]) -> DataFrame:
    """(doc_id, n_words, spans, items, near): merged hit spans, the items found, and those
    found by proximity."""
    shared = found.sparkSession.sparkContext.broadcast(([p.count(b" ") + 1 for p in test], items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, of = shared.value
        for batch in batches:
            spans, hit = [], []
            close = [sorted({i for k in ks for i in of[k]}) for ks in batch.column(5).to_pylist()]
            for starts, which in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                merged: list[list[int]] = []
                for s, e in sorted((s, s + length[k]) for s, k in zip(starts, which, strict=True)):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(e, merged[-1][1])
                    else:
                        merged.append([s, e])
                spans.append(merged)
                hit.append(sorted({i for k in set(which) for i in of[k]}))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(hit, pa.list_(pa.int64())), pa.array(close, pa.list_(pa.int64()))], names=["doc_id", "digest", "n_words", "spans", "items", "near"])

    return found.mapInArrow(run, "doc_id long, digest long, n_words long, spans array<array<long>>, items array<long>, near array<long>")


def _merge(passes: list[DataFrame]) -> DataFrame:
    """Union the spans and items that several passes found in each document.

    Rows are told apart by id and text digest; repeated rows have equal results and
    are put back as often as they came.
    """
    n = len(passes)
    every = passes[0]
    for p in passes[1:]:
        every = every.unionByName(p)
    every = every.groupBy("doc_id", "digest").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), (F.count("*") / n).cast("int").alias("copies"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end"))
    total = F.aggregate(F.array_sort("spans"), start, lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), s[1] - F.greatest(s[0], a["end"]))).alias("n"), F.greatest(a["end"], s[1]).alias("end")), lambda a: a["n"])
    return every.withColumn("n_hit", total).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copy", "copies", "digest")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, phrase_bytes: int = PHRASE_BYTES, within: int | None = WITHIN) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items, near) of every document; ``near`` are the
    items with a window all of whose words lie within ``within`` words of its first."""
    done = []
    for test, items in phrase_blocks(phrases(benchmark, window), phrase_bytes):
        terms = {w for p in test for w in p.split(b" ")}
        index = written(build_index(docs, terms), "postings")
        done.append(_report(search(index, test, terms, also=within, items=items), test, items))
    if len(done) == 1:
        n = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
        return done[0].withColumn("n_hit", n).drop("digest")
    return _merge(done)
