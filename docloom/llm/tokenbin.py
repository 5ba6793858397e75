"""Token-ID / binary output: patched frame-of-reference blocks.

Documents are range-partitioned by ``doc_id``; each task encodes its texts in
order and writes *segments*.  A segment is a self-contained binary value that
holds whole documents: a document table, then blocks of ``BLOCK`` ids, then an
index of where every block starts.  A block stores its minimum, the ids less that
minimum packed at a percentile-chosen width, and the ids that do not fit as an
exception list.  Segments are rows of a Parquet table (Spark's committer makes the
write survive lost executors; any store that Spark writes to will do).

Segment layout, little-endian::

    magic "PFR1" | u32 documents | u32 ids | u32 blocks
    i64 doc_id[documents] | u8 null[documents] | u32 n_ids[documents]
    u32 block_start[blocks + 1]                  # offsets into what follows
    block: u32 n | u32 minimum | u8 width | u32 exceptions
           packed bits (n * width, MSB first) | u32 position[e] | u32 value[e]

Edge cases: a null text is an empty text (it still gets the end id); empty tables
give empty tables; a null ``doc_id`` sorts first; rows of one id (or of none) are kept,
ordered by a hash of their text and dealt out by it; a very long text is a segment of its
own; other columns of the input are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import blocks, freeing, n_parts, new_path

BLOCK = 4096
SEGMENT_IDS = 1 << 18
PERCENTILE = 0.95
#: Shuffle partitions' worth of text that one encoder and its word cache serve.
SHARE = 2
#: Words whose ids an encoder remembers.
WORDS = 700_000
_HEAD, _HEAD_SIZE = "<4sIII", 16
_BLOCK, _BLOCK_SIZE = "<IIBI", 13


def pack_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One patched frame-of-reference block of uint32 ids."""
    low = int(ids.min())
    rest = (ids - np.uint32(low)).astype(np.uint32)
    width = int(np.quantile(rest, percentile, method="higher")).bit_length()
    over = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    kept = rest.copy()
    kept[over] = 0
    if width == 0:
        bits = b""
    elif width <= 16:
        bits = np.packbits(np.unpackbits(kept.astype(">u2").view(np.uint8)).reshape(-1, 16)[:, 16 - width :]).tobytes()
    else:
        bits = np.packbits(np.unpackbits(kept.astype(">u4").view(np.uint8)).reshape(-1, 32)[:, 32 - width :]).tobytes()
    return struct.pack(_BLOCK, len(ids), low, width, len(over)) + bits + over.astype("<u4").tobytes() + rest[over].astype("<u4").tobytes()


def unpack_block(data: memoryview) -> np.ndarray:
    n, low, width, extra = struct.unpack_from(_BLOCK, data)
    at = _BLOCK_SIZE
    size = (n * width + 7) // 8
    if width == 0:
        out = np.zeros(n, np.uint32)
    else:
        lanes, kind = (16, ">u2") if width <= 16 else (32, ">u4")
        wide = np.zeros((n, lanes), np.uint8)
        wide[:, lanes - width :] = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n * width).reshape(n, width)
        out = np.packbits(wide).view(kind).astype(np.uint32)
    at += size
    where = np.frombuffer(data, "<u4", extra, at)
    out[where] = np.frombuffer(data, "<u4", extra, at + 4 * extra)
    return out + np.uint32(low)


def pack_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    packed = [pack_block(ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
    starts = np.cumsum([0, *map(len, packed)])
    return b"".join(
        [
            struct.pack(_HEAD, b"PFR1", len(doc_ids), len(ids), len(packed)),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array([d is None for d in doc_ids], "u1").tobytes(),
            np.array(lengths, "<u4").tobytes(),
            starts.astype("<u4").tobytes(),
            *packed,
        ]
    )


def unpack_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, ids per document, all ids) of a segment."""
    magic, docs, total, count = struct.unpack_from(_HEAD, data)
    if magic != b"PFR1":
        raise ValueError("not a token segment")
    at = _HEAD_SIZE
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    null = np.frombuffer(data, "u1", docs, at + 8 * docs)
    lengths = np.frombuffer(data, "<u4", docs, at + 9 * docs).astype(np.int64)
    at += 13 * docs
    starts = np.frombuffer(data, "<u4", count + 1, at)
    at += 4 * (count + 1)
    view = memoryview(data)
    parts = [unpack_block(view[at + int(a) : at + int(b)]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    ids = np.concatenate(parts) if parts else np.empty(0, np.uint32)
    if len(ids) != total or lengths.sum() != total:
        raise ValueError("token segment is damaged")
    return [None if x else int(d) for d, x in zip(doc_ids, null, strict=True)], lengths, ids


def read_block(data: bytes, block: int) -> np.ndarray:
    """Ids of one block, found through the index without unpacking the others."""
    _, docs, _, count = struct.unpack_from(_HEAD, data)
    at = _HEAD_SIZE + 13 * docs
    a, b = np.frombuffer(data, "<u4", 2, at + 4 * block)
    at += 4 * (count + 1)
    return unpack_block(memoryview(data)[at + int(a) : at + int(b)])


class Words(dict):
    """uint32 ids of words with their leading space, found on first use.

    The pre-tokenizer keeps a run of letters with the space before it as one piece
    and a run of plain punctuation after it as another, so those go straight to the
    library's BPE model; any other word goes through the whole tokenizer.
    """

    def __init__(self, whole, model, most: int):
        super().__init__()
        self.whole, self.model, self.most, self.parts = whole, model.tokenize, most, {}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        #: byte-level alphabet: printable bytes stand for themselves, others follow 255
        self.letters = {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.space = self.letters[32]
        self.line_end = whole("\n")

    def _ids(self, piece: str) -> bytes:
        raw = piece if piece.isascii() else piece.encode().decode("latin1").translate(self.letters)
        return array("I", [t.id for t in self.model(raw.replace(" ", self.space))]).tobytes()

    def _word(self, space: str, word: str) -> bytes:
        stem = word.rstrip(_PUNCTUATION)
        if not stem.isalpha():
            return self.whole(space + word)
        if len(stem) == len(word):
            return self._ids(space + word)
        known = self if space else self.parts
        ids, tail = known.get(stem), word[len(stem) :]
        if ids is None:
            ids = known[stem] = self._ids(space + stem)
        if tail not in self.parts:
            self.parts[tail] = self._ids(tail)
        return ids + self.parts[tail]

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
            self.parts.clear()
        lines = word.split("\n")
        if len(lines) > 1 and all(x and not x[0].isspace() and not x[-1].isspace() for x in lines):
            # a line end between two non-spaces is a piece of its own
            rest = [self.line_end]
            for x in lines[1:]:
                ids = self.parts.get(x)
                if ids is None:
                    ids = self.parts[x] = self._word("", x)
                rest += [ids, self.line_end]
            self[word] = ids = self[lines[0]] + b"".join(rest[:-1])
            return ids
        ids = self[word] = self._word(" ", word)
        return ids


class Encoder:
    """Byte-level BPE through the tokenizers library, each word encoded once.

    The pre-tokenizer always cuts before a space that a non-space follows, so a
    text is the sequence of its words, each with its leading space.  Texts with an
    added token's string in them are encoded whole.
    """

    def __init__(self, path: str, words: int = WORDS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.words = Words(self._whole, self.tok.model, words)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """uint32 little-endian ids of a text."""
        if any(a in text for a in self.added):
            return self._whole(text)
        words = re.split(r" (?=\S)", text) if _ODD.search(text) else text.split(" ")
        first = self._whole(words[0]) if words[0] else b""
        return first + b"".join(map(self.words.__getitem__, words[1:]))


_ODD = re.compile(r" \s")
_PUNCTUATION = ".,!?;:%*#$&()-/"


def ordered(docs: DataFrame, order: list[Column], partitions: int | None = None) -> DataFrame:
    """Texts range-partitioned by the first two of ``order`` and sorted by all of it;
    partition i is not after i + 1."""
    return docs.repartitionByRange(partitions or max(1, n_parts(docs.sparkSession) // SHARE), *order[:2]).sortWithinPartitions(*order)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, order: list[Column] | None = None, words: int = WORDS) -> None:
    """Write the ids of all documents as segments: (shard, seq, n_ids, data).

    ``order`` sets the order of the ids and is ``doc_id``, then text by its hash, by
    default; an encoder remembers the ids of ``words`` words.
    """
    order = order or [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = Encoder(tokenizer, words), np.array([end_id], "<u4").tobytes()
        shard, seq, inside = TaskContext.get().partitionId(), 0, 0
        ids_, lengths, raw, held = [], [], [], 0

        def flush():
            nonlocal seq, held, inside
            ids = np.frombuffer(b"".join(raw), "<u4")
            row = {"shard": [shard], "seq": [seq], "inside": [inside], "n_ids": [len(ids)], "data": [pack_segment(ids_, lengths, ids)]}
            seq, held, inside = seq + 1, 0, inside + len(ids)
            ids_.clear(), lengths.clear(), raw.clear()
            return pa.RecordBatch.from_pydict(row, schema=_SCHEMA)

        for part, ts in blocks(batches):
            for d, r in zip(part.column(0).to_pylist(), map(enc.encode, ts), strict=True):
                n = len(r) // 4 + 1
                if ids_ and held + n > SEGMENT_IDS:
                    yield flush()
                ids_.append(d), lengths.append(n), raw.append(r + end)
                held += n
        if ids_:
            yield flush()

    ordered(texts_with(docs), order).select("doc_id", "text").mapInArrow(freeing(run), "shard int, seq int, inside long, n_ids long, data binary").write.option("parquet.block.size", 16 << 20).option("compression", "uncompressed").parquet(path)


_SCHEMA = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("inside", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())])


def texts_with(docs: DataFrame) -> DataFrame:
    """Null texts become empty; other columns stay, as an order may name them."""
    return docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.coalesce(F.col("text").cast("string"), F.lit(""))})


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Segments with ``first``: how many ids all earlier segments hold.

    Each segment carries what its own shard holds before it; the window and the
    broadcast see one row per shard, that is per write task.
    """
    seg = spark.read.schema("shard int, seq int, inside long, n_ids long, data binary").parquet(path)
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = seg.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    return seg.join(F.broadcast(base), "shard").withColumn("first", F.col("base") + F.col("inside"))


def decode_documents(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids, lengths, ids = unpack_segment(data.as_py())
                ends = np.cumsum(lengths)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(first + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return segments.select("first", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0, order: list[Column] | None = None, words: int = WORDS) -> DataFrame:
    """Write all ids to the shared folder, read the files back, digest each document."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id, order, words)
    return decode_documents(read_tokens(spark, path))
