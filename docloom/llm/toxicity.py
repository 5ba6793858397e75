"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

Three models, all trained here.

* A character trigram model of the corpus: counts over all documents, at most
  ``28 ** 3`` sums whatever the corpus size, mixed half and half with the trigrams of
  the lexicon so that the words sought are not improbable under it.
* A lexicon: words whose document frequency is higher in toxic than in clean training
  rows by more than chance (z of the smoothed log odds over ``Z``).
* A logistic model over what the lexicon finds in a document's text and in its
  restored words.

Words written with digits or signs for letters, spaced out letter by letter, or with
letters repeated become lattices: every character offers the letters it may stand for,
every run its letter once or twice, and between spaced letters a word may end.  Viterbi
decoding finds the most probable letters under channel and character model, whatever the
length, and the decoded words are scored with the plain ones.

Training uses at most ``TRAIN_ROWS`` labelled rows, those with the smallest hash of
their id; corpus counts and scores cover all documents.  Only the text is an input.

Edge cases: null texts are empty; empty texts get the score of no findings; rows without
a label, null labels and repeated labels are fine (each label row counts); with no labels
of one class every score is the smoothed share of toxic rows; null ids are never held out;
very long texts and tokens are taken whole, in time in proportion to their length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import blocks, freeing, texts, written

#: Most labelled rows that models are fitted on.
TRAIN_ROWS = 20_000
Z = 5.0
#: Most words of the lexicon, those of the largest z: a bound of the model, not of the texts.
LEXICON = 400
FOLDS = 5

# Letters that a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "*": "aeiou",
}
# A token is tried from its start only, and runs are not given back, so time is linear.
_SIGN = re.compile(r"(?<![A-Za-z0-9@$!|+])(?:[A-Za-z]++[0-9@$!|+*]++|[0-9@$!|+]++[A-Za-z])[A-Za-z0-9@$!|+*]*+")
_ENDS = re.compile(r"[@$!|+*]++\Z")
_SPACED = re.compile(r"(?<![A-Za-z0-9@$])[A-Za-z0-9@$](?:([ ._-])[A-Za-z0-9@$!|*])(?:\1[A-Za-z0-9@$!|*])+(?![A-Za-z0-9@$])")
_RUN = re.compile(r"([A-Za-z])\1\1+", re.I)
_NOT_WORD = re.compile(r"[\W_]")
#: Words of so many letters are looked for anywhere in spaced letters.
_WHOLE = 5
#: Decoded tokens of up to so many characters are remembered.
_SHORT = 64
#: Lower-cases A-Z and turns ASCII that is no letter or digit into a space.
_TABLE = bytes(c if chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: 0: no letter, 1-26: a-z, 27: a byte of another letter
_CLASS = np.array([c - 96 if 97 <= c <= 122 else c - 64 if 65 <= c <= 90 else 27 if c > 127 else 0 for c in range(256)], np.int32)
_N = 28


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of character trigrams over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_N**3, np.int64)
        for _, ts in blocks(batches):
            raw = np.frombuffer(" ".join(["", *ts, ""]).encode("utf-8", "surrogatepass"), np.uint8)
            c = _CLASS[raw]
            total += np.bincount((c[:-2] * _N + c[1:-1]) * _N + c[2:], minlength=_N**3) if len(c) > 2 else 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["gram", "n"])

    out = np.zeros(_N**3)
    for r in texts(docs).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[r.gram] = r.n
    return out


def char_model(corpus: np.ndarray, lexicon: list[str]) -> np.ndarray:
    """log P(c | a, b) as an array [a, b, c]."""
    own = np.zeros(_N**3)
    for w in lexicon:
        c = [0, 0, *(_CLASS[x] for x in w.encode()), 0]
        for k in range(len(c) - 2):
            own[(c[k] * _N + c[k + 1]) * _N + c[k + 2]] += 1
    parts = []
    for n in (corpus, own):
        n = n.reshape(_N, _N, _N)
        back = n.sum(0) + 0.5
        back /= back.sum(1, keepdims=True)
        parts.append((n + 2 * back[None]) / (n.sum(2, keepdims=True) + 2))
    return np.log(0.5 * parts[0] + 0.5 * parts[1])


def lattice(token: str, spaced: bool = False) -> list[list[tuple[tuple[int, ...], float]]]:
    """Per run of equal characters what it may stand for: (letters, cost).

    A letter stands for itself, another sign for the letters of ``LEET``; a run for its
    letter once or twice; with ``spaced``, 0 after a run's letters ends a word."""
    runs: list[list] = []
    for ch in token.lower():
        if runs and runs[-1][0] == ch and ch != "*":
            runs[-1][1] += 1
        else:
            runs.append([ch, 1])
    out = []
    for k, (ch, times) in enumerate(runs):
        offers = [(ch, 0.0)] if ch.isascii() and ch.isalpha() else [(x, -1.0) for x in LEET.get(ch, "")]
        step = []
        for letter, cost in offers:
            c = ord(letter) - 96
            step.append(((c,), cost - (3.0 if times == 2 else 0.0)))
            if times > 1:
                step.append(((c, c), cost - (0.7 if times > 2 else 0.0)))
        if spaced and k < len(runs) - 1:
            step += [((*said, 0), cost) for said, cost in step]
        if step:
            out.append(step)
    return out


def decode(token: str, model: np.ndarray, spaced: bool = False) -> str:
    """Most probable letters behind ``token`` (Viterbi over its lattice); words of a
    spaced one are parted by spaces.  The state is the last two characters."""
    best: dict[tuple[int, int], float] = {(0, 0): 0.0}
    back: list[dict[tuple[int, int], tuple[tuple[int, int], tuple[int, ...]]]] = []
    for step in lattice(token, spaced):
        new: dict[tuple[int, int], float] = {}
        came: dict[tuple[int, int], tuple[tuple[int, int], tuple[int, ...]]] = {}
        for state, score in best.items():
            for said, cost in step:
                (a, b), v = state, score + cost
                for c in said:
                    v += model[a, b, c]
                    a, b = b, c
                if (a, b) not in new or v > new[a, b]:
                    new[a, b], came[a, b] = v, (state, said)
        best = new
        back.append(came)
    state = max(best, key=lambda s: best[s] + model[s[0], s[1], 0])
    out: list[int] = []
    for came in reversed(back):
        state, said = came[state]
        out += reversed(said)
    return "".join(chr(c + 96) if c else " " for c in reversed(out))


def suspects(text: str) -> list[tuple[str, bool]]:
    """Tokens of ``text`` that look written to hide a word, and whether they were spaced."""
    out = []
    for m in _SIGN.finditer(text):
        t = _ENDS.sub("", m[0])
        if len(t) >= 3 and not t.isalpha() and sum(c.isalpha() for c in t) * 3 >= len(t):
            out.append((t, False))
    for m in _SPACED.finditer(text):
        out.append((m[0][::2], True))
    done = 0
    for m in _RUN.finditer(text):
        if m.start() < done:
            continue
        a = m.start()
        while a > done and text[a - 1].isalnum():
            a -= 1
        end = _NOT_WORD.search(text, m.end())
        done = end.start() if end else len(text)
        t = text[a:done]
        if t.isascii():
            out.append((t, False))
    return out


@dataclass
class Findings:
    """Finds lexicon words in plain and restored text."""

    weight: dict[bytes, float]
    model: np.ndarray

    def __post_init__(self):
        self.lexicon = frozenset(self.weight)
        self.known: dict[tuple[str, bool], list[bytes]] = {}

    def of(self, text: str) -> list[float]:
        w = words(text)
        plain = self.lexicon.intersection(w)
        hits = [(x, w.count(x)) for x in plain]
        hidden = []
        for t, spaced in suspects(text):
            found = self.known.get((t, spaced))
            if found is None:
                said = decode(t, self.model, spaced).encode()
                found = [x for x in said.split(b" ") if x in self.lexicon]
                if spaced:  # where one word ends and the next begins may be anyone's guess
                    said = said.replace(b" ", b"")
                    found += [x for x in self.lexicon if len(x) >= _WHOLE and x in said and x not in found]
                if len(t) <= _SHORT:
                    if len(self.known) > 100_000:
                        self.known.clear()
                    self.known[t, spaced] = found
            hidden += [x for x in found if x not in plain]
        total = sum(self.weight[x] * n for x, n in hits) + sum(self.weight[x] for x in hidden)
        many = sum(n for _, n in hits) + len(hidden)
        top = max([self.weight[x] for x, _ in hits] + [self.weight[x] for x in hidden], default=0.0)
        kinds = len({x for x, _ in hits} | set(hidden))
        return [float(many > 0), np.log1p(total), top, float(min(kinds, 8)), 1000.0 * many / (len(w) + 100), float(bool(hidden))]


def _held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, toxic): labelled rows that are not held out, ``most`` at most."""
    own = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
    own = own.where("label_id is not null and toxic is not null").where(F.expr(f"crc32(cast(label_id as string)) % {FOLDS} <> 0"))
    own = own.orderBy(F.xxhash64("label_id"), "label_id", "toxic").limit(most)
    rows = texts(docs)
    return rows.join(F.broadcast(own), rows["doc_id"] == own["label_id"]).select("doc_id", "text", "toxic")


def learn_lexicon(train: DataFrame) -> tuple[list[tuple[str, float]], int, int]:
    """([(word, log odds)], toxic rows, clean rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ts in blocks(batches, 4 << 20):
            n: tuple[dict[bytes, int], dict[bytes, int]] = ({}, {})
            for t, y in zip(ts, part.column(2).to_pylist(), strict=True):
                own = n[int(y == 1)]
                for w in set(words(t)):
                    own[w] = own.get(w, 0) + 1
            # a word of no toxic row here is of use only where another block has it
            every = list(n[0].keys() | n[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.binary()), pa.array([n[1].get(w, 0) for w in every], pa.int64()), pa.array([n[0].get(w, 0) for w in every], pa.int64())], names=["word", "pos", "neg"])

    # copies of one text are one observation
    train = train.dropDuplicates(["text", "toxic"])
    size = {r.toxic: r.n for r in train.groupBy((F.col("toxic") == 1).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    pos, neg = size.get(1, 0), size.get(0, 0)
    if not pos or not neg:
        return [], pos, neg
    n = train.mapInArrow(freeing(run), "word binary, pos long, neg long").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (pos - F.col("pos") + 0.5)) - F.log((F.col("neg") + 0.5) / (neg - F.col("neg") + 0.5))
    error = F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    best = n.where("pos >= 3").select("word", odds.alias("odds"), (odds / error).alias("z")).where(F.col("z") > Z).orderBy(F.desc("z"), "word").limit(LEXICON).collect()
    return [(bytes(r.word).decode("utf-8", "replace"), float(r.odds)) for r in best], pos, neg


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton steps on scaled features: (weights, mean, scale)."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (p - y) + ridge * np.r_[w[:-1], 0])
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, scale


def _map_texts(rows: DataFrame, maker: Callable, schema: str, names: list[str], keep: list[int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = maker()
        for part, ts in blocks(batches):
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *of(part, ts)], names=names)

    return rows.mapInArrow(freeing(run), schema)


def score(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score) of every document; ``id_col`` is given out as doc_id,
    labels are always found by ``doc_id``."""
    train = written(training_rows(docs, labels, train_rows), "toxic-train")
    lexicon, pos, neg = learn_lexicon(train)
    model = char_model(trigram_counts(docs), [w for w, _ in lexicon if w.isascii()])
    weight = {w.encode(): o for w, o in lexicon}

    def features():
        found = Findings(weight, model)
        return lambda part, ts: [pa.array([found.of(t) for t in ts], pa.list_(pa.float64()))]

    if lexicon:
        rows = _map_texts(train, features, "toxic int, x array<double>", ["toxic", "x"], [2]).collect()
        w, mean, scale = fit(np.array([r.x for r in rows]), np.array([float(r.toxic == 1) for r in rows]))
    else:
        share = (pos + 1) / (pos + neg + 2)
        w, mean, scale = np.r_[np.zeros(6), np.log(share / (1 - share))], np.zeros(6), np.ones(6)

    def scores():
        found = Findings(weight, model)

        def of(part, ts):
            x = (np.array([found.of(t) for t in ts]) - mean) / scale
            p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            return [pa.array([_held_out(d) for d in part.column(0).to_pylist()]), pa.array(p)]

        return of

    return _map_texts(texts(docs, id_col), scores, "doc_id long, held_out boolean, score double", ["doc_id", "held_out", "score"], [0])
