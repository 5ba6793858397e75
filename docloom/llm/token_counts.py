"""Token counts: count the pieces of each distinct pre-token once, join, sum.

A sentencepiece BPE model whose pieces hold the space mark only at their start
never merges across the start of a run of spaces, so a text is the sequence of its
pre-tokens (a run of spaces and what follows it) and its token count is the sum of
theirs.

One pass over the texts makes *blocks* of documents.  A block keeps its distinct
pre-tokens, numbered, and each document's (number, frequency) pairs.  Distinct
pre-tokens go to the bucket of their hash, where each is counted once whatever the
number of blocks that hold it; the counts return to their blocks and are joined to
the frequencies there.  A pre-token leaves a block once, so a common word or a hot
source costs no more than one entry per block.  No ids of documents are made.

Edge cases: a null text is empty; an empty text has no tokens; null and repeated
``doc_id`` keep their own rows; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import blocks, n_parts, texts

#: Bytes of text whose pre-tokens share one vocabulary.
VOCABULARY_BYTES = 32 << 20
_ROW = pa.schema([("to", pa.int64()), ("block", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary())])
_ROW_DDL = "to long, block long, bucket int, data binary"
_MARK = "▁"


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens without their first space; further spaces are written as marks."""
    t = text.replace(_MARK, " ") if _MARK in text else text
    if not t:
        return []
    if "  " in t or t[0] == " " or t[-1] == " ":
        return [p[1:].replace(" ", _MARK) for p in re.findall(" +[^ ]*", " " + t)]
    return t.split(" ")


class PieceCounter:
    """Number of pieces of pre-tokens, each counted once."""

    def __init__(self, model: str, most: int = 1_000_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        if bad := [p for p in map(self.model.id_to_piece, range(self.model.get_piece_size())) if _MARK in p.lstrip(_MARK)]:
            raise ValueError(f"pieces span pre-tokens: {bad[:3]}")
        self.known, self.most = {"": 1}, most  # the empty rest is a last lone space: one mark

    def counts(self, words: list[str]) -> list[int]:
        new = list({*words}.difference(self.known))
        if len(self.known) + len(new) > self.most:
            self.known = {"": 1}
            new = list({*words}.difference(self.known))
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            self.known.update(zip(part, map(len, self.model.encode(part, num_threads=1)), strict=True))
        return list(map(self.known.__getitem__, words))


def _zip(*arrays: np.ndarray) -> bytes:
    out = []
    for a in arrays:
        raw = a.tobytes()
        z = pa.compress(raw, codec="zstd", asbytes=True) if raw else b""
        out += [np.array([len(raw), len(z)], "<u8").tobytes(), z]
    return b"".join(out)


def _unzip(data: bytes, *kinds: str) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        size, z = np.frombuffer(data, "<u8", 2, at).tolist()
        at += 16
        out.append(np.frombuffer(pa.decompress(data[at : at + z], size, codec="zstd") if size else b"", kind))
        at += z
    return out


def _make_blocks(buckets: int, vocabulary_bytes: int):
    def close(number, vocab, ids, null, sizes, pairs):
        words = list(vocab)
        bucket = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets for w in words), "<u4", len(words))
        order = np.argsort(bucket, kind="stable")
        present, at = np.unique(bucket[order], return_index=True)
        cut = [*at.tolist(), len(words)]
        many = np.array([len(i) for i, _ in pairs], "<u4")
        index = np.concatenate([np.diff(i, prepend=0) for i, _ in pairs] or [[]]).astype("<u4")
        freq = np.concatenate([f for _, f in pairs] or [[]]).astype("<u4")
        data = [" ".join([words[k] for k in order[a:b]]).encode("utf-8", "surrogatepass") for a, b in zip(cut[:-1], cut[1:], strict=True)]
        data.append(_zip(np.array(ids, "<i8"), np.array(null, "u1"), np.array(sizes, "<i8"), many, index, freq, bucket))
        to = [*present.tolist(), number % buckets]
        return pa.RecordBatch.from_pydict({"to": to, "block": [number] * len(to), "bucket": [*present.tolist(), -1], "data": data}, schema=_ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, 0
        state: tuple = ({}, [], [], [], [])
        for part, ts in blocks(batches):
            size = part.column(2).to_pylist()
            if held and held + sum(size) > vocabulary_bytes:
                yield close(number, *state)
                number, held, state = number + 1, 0, ({}, [], [], [], [])
            vocab, ids, null, sizes, pairs = state
            for d, t, n in zip(part.column(0).to_pylist(), ts, size, strict=True):
                words = pre_tokens(t)
                for w in {*words}.difference(vocab):
                    vocab[w] = len(vocab)
                pairs.append(np.unique(np.fromiter(map(vocab.__getitem__, words), np.int64, len(words)), return_counts=True))
                ids.append(d or 0), null.append(d is None), sizes.append(n)
            held += sum(size)
        if held or state[1]:
            yield close(number, *state)

    return run


def _count(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceCounter(model)
        for batch in batches:
            out = []
            for bucket, data in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                raw = data.as_py()
                if bucket >= 0:
                    raw = _zip(np.array(pieces.counts(raw.decode("utf-8", "surrogatepass").split(" ")), "<u4"))
                out.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(out, pa.binary())], names=["block", "bucket", "data"])

    return run


def _sum(table: pa.Table) -> pa.Table:
    rows = sorted(zip(table.column("bucket").to_pylist(), table.column("data"), strict=True), key=lambda r: r[0])
    ids, null, sizes, many, index, freq, bucket = _unzip(rows[0][1].as_py(), "<i8", "u1", "<i8", "<u4", "<u4", "<u4", "<u4")
    count = np.zeros(len(bucket), np.int64)
    if len(bucket):
        count[np.argsort(bucket, kind="stable")] = np.concatenate([_unzip(d.as_py(), "<u4")[0] for _, d in rows[1:]])
    ends = np.cumsum(many.astype(np.int64))
    # numbers are stored as differences inside each document
    number = np.cumsum(index.astype(np.int64))
    start = np.concatenate([[0], number])[ends - many]
    number -= np.repeat(start, many)
    total = np.concatenate([[0], np.cumsum(count[number] * freq)])
    return pa.table(
        {
            "doc_id": pa.array(ids, mask=null.astype(bool), type=pa.int64()),
            "n_bytes": pa.array(sizes, pa.int64()),
            "n_tokens": pa.array(total[ends] - total[ends - many], pa.int64()),
        }
    )


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, vocabulary_bytes: int = VOCABULARY_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``."""
    parts = n_parts(docs.sparkSession)
    made = texts(docs).withColumn("n", F.octet_length("text")).mapInArrow(_make_blocks(parts, vocabulary_bytes), _ROW_DDL)
    counted = made.repartition(parts, "to").mapInArrow(_count(model), "block long, bucket int, data binary")
    out = counted.groupBy("block").applyInArrow(_sum, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
