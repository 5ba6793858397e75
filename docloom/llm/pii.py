"""Personal data by weak supervision.

Candidate spans are what the base patterns match, and looser forms of the same and
of a few other kinds.  Labelers vote on each candidate: 1 personal, 0 not, 2 no
opinion (``LABELERS``: strict pattern, checksum, gazetteer, context words, word borders).
The counts of vote patterns over the whole corpus are a small table; expectation-
maximisation on it estimates each labeler's reliability per kind and the posterior
of each pattern, and a logistic model trained on those posteriors (votes and the
span's shape as features) is the final span classifier.  Base spans always stay; a
looser span is added where the classifier gives it 0.5 or more and no base span
overlaps it.

The votes and shapes are discrete, so what reaches the driver is one count per
(kind, votes, shape): at most ``len(KINDS) * 3 ** 5 * 8`` rows at any corpus size.

Edge cases: null texts are empty and have no spans; null and repeated ``doc_id`` keep
their own rows; very long texts, also of one token, take time in proportion to their
length; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import blocks, freeing, texts, written

KINDS = ("email", "ip", "card", "phone", "name", "ssn", "secret")
BASE = 4
LABELERS = ("pattern", "checksum", "gazetteer", "context", "border")

# Base patterns of the contract.  Runs are taken whole and only from their
# start on, which finds the same matches and makes no second try inside a run.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Looser forms: (kind, text that must be in the case-folded document, pattern).
LOOSE = (
    ("email", ("[at]", "(at)", "{at}"), re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[({]at[\])}] ?[A-Za-z0-9-]+(?: ?(?:[\[({]dot[\])}]|\.) ?[A-Za-z0-9-]+)+")),
    ("ip", (":",), re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])")),
    ("card", ("3",), re.compile(r"(?<![\w.-])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![\w-])")),
    ("phone", ("-", ".", ")"), re.compile(r"(?<![\w+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![\w-])")),
    ("ssn", ("-",), re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    ("name", ("name", "mr.", "mrs.", "ms.", "dr.", "prof.", "i am ", "i'm ", "sincerely", "regards", "signed"), re.compile(r"(?:(?<=[Nn]ame is )|(?<=[Nn]ame: )|(?<=NAME: )|(?<=\bMr\. )|(?<=\bMrs\. )|(?<=\bMs\. )|(?<=\bDr\. )|(?<=\bProf\. )|(?<=\bI am )|(?<=\bI'm )|(?<=[Ss]incerely, )|(?<=[Rr]egards, )|(?<=[Ss]igned, ))[A-Z][a-z]+(?: [A-Z][a-z]+){0,2}")),
    ("name", (), re.compile(r"\b(?:@FIRST@) [A-Z][a-z]+\b")),
    ("secret", ("token", "secret", "key", "passw"), re.compile(r"(?i:(?:token|secret|api[_-]?key|passw(?:or)?d)\s*[=:]\s*[\"']?)([A-Za-z0-9_/+-]{16,})")),
    ("secret", ("akia", "asia", "gh", "eyj"), re.compile(r"(?<!\w)(?:(?:AKIA|ASIA)[0-9A-Z]{16}(?!\w)|gh[pousr]_[A-Za-z0-9]{36,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]+)")),
    ("secret", (), re.compile(r"(?<!\w)(?=[a-f]*[0-9])(?:[0-9a-f]{40}|[0-9a-f]{64})(?!\w)")),
)

# Gazetteers and cue words.
TLDS = frozenset("com org net edu gov mil int info biz io dev app co uk de fr es it nl eu us ca au ch at be se no dk fi pl jp cn in br ru test example".split())
FIRST_NAMES = frozenset(
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah "
    "Charles Karen Maria Anna Peter Paul Laura Julia Hans Klaus Pierre Marie Jean Carlos Ana Juan Luis Sofia Emma Lukas Felix".split()
)
LOOSE = tuple((k, c, re.compile(p.pattern.replace("@FIRST@", "|".join(sorted(FIRST_NAMES))))) for k, c, p in LOOSE)
CUES = {
    "email": "mail contact write address reach",
    "ip": "ip address host server login",
    "card": "card visa master credit payment amex",
    "phone": "phone tel call mobile fax contact number",
    "name": "name mr mrs ms dr prof sincerely regards signed",
    "ssn": "ssn social security",
    "secret": "token secret key password passwd",
}
AGAINST = "version release section isbn issn doi order invoice sku chapter page"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the email pattern, found from each @ outward."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def _byte(part: str) -> bool:
    """Whether digits are a number of 255 at most, however many there are."""
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) < 256


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base patterns, leftmost and non-overlapping."""
    out = [(0, a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(map(_byte, m[0].split(".")))]
        for m in CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(d) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


_DIGIT, _NOT_DIGIT = re.compile("[0-9]"), re.compile("[^0-9]")
#: Strict forms that the pattern labeler holds looser spans against.
_STRICT = {
    "email": re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]* ?[\[({]at[\])}] ?[A-Za-z0-9-]+(?: ?(?:[\[({]dot[\])}]|\.) ?[A-Za-z0-9-]+)* ?(?:[\[({]dot[\])}]|\.) ?[A-Za-z]{2,}"),
    "ip": re.compile(r"(?!(?:0{1,4}:){7})[0-9A-Fa-f:]+"),
    "card": re.compile(r"3[47][0-9]{2}([ -]?)[0-9]{6}\1[0-9]{5}"),
    "phone": re.compile(r"(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}([.-]))[2-9][0-9]{2}(?:\1|-)[0-9]{4}"),
    "ssn": re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}"),
    "name": re.compile(r"[A-Z][a-z]{1,14}(?: [A-Z][a-z]{1,19}){1,2}"),
    "secret": re.compile(r"[0-9a-fA-F]{32,}|(?:AKIA|ASIA|gh[pousr]_|eyJ).+|(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z]).{20,}"),
}


def votes(kind: str, text: str, start: int, end: int, base: bool) -> tuple[list[int], int]:
    """Votes of the labelers on a span, and its shape (three bits)."""
    span = text[start:end]
    digits = _NOT_DIGIT.sub("", span)
    before = re.findall(r"[a-z]+", text[max(0, start - 40) : start].lower())
    if kind == "email":
        check = 1 if "." in span.replace("dot", ".") and ".." not in span else 0
        tail = re.split(r"[^A-Za-z]+", span.rstrip("."))[-1].lower()
        known = 1 if tail in TLDS else 0
    elif kind == "ip":
        check = 1 if ":" in span or all(p == (p.lstrip("0") or "0") for p in span.split(".")) else 0
        known = 0 if span.startswith(("0.", "255.")) else 2
    elif kind == "card":
        check = int(luhn(digits))
        known = 1 if digits[:1] in "3456" else 0
    elif kind == "phone":
        check = int(8 <= len(digits) <= 15)
        known = 0 if len(set(digits)) < 3 else 2
    elif kind == "ssn":
        check = int(digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000")
        known = 2
    elif kind == "name":
        check = 2
        known = 1 if span.split()[0] in FIRST_NAMES else 2
    else:
        check = int(any(c.isdigit() for c in span) and any(c.isalpha() for c in span))
        known = 1 if re.fullmatch(r"[0-9a-fA-F]{32,64}", span) else 2
    cues = CUES[kind].split()
    context = 1 if any(w.startswith(c) for w in before for c in cues) else 0 if any(w in AGAINST.split() for w in before[-2:]) else 2
    glued = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    shape = (len(span) > 12) + 2 * (2 * len(digits) > len(span)) + 4 * any(c in " -" for c in span)
    return [1 if base else int(bool(_STRICT[kind].fullmatch(span))), check, known, context, 0 if glued else 1], int(shape)


class _Taken:
    """Disjoint spans in order of place, asked and added to by bisection."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, start: int, end: int) -> bool:
        """Whether no span shares a character with this one."""
        at = bisect_left(self.starts, end)
        return not at or self.ends[at - 1] <= start

    def put(self, start: int, end: int) -> None:
        """Add a span that is ``free``."""
        at = bisect_left(self.starts, start)
        self.starts.insert(at, start)
        self.ends.insert(at, end)

    def join(self, start: int, end: int) -> None:
        """Add a span that starts no earlier than all others; overlaps become one."""
        if self.ends and start < self.ends[-1]:
            self.ends[-1] = max(end, self.ends[-1])
        else:
            self.starts.append(start)
            self.ends.append(end)


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): every document and its candidate spans with votes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ts in blocks(batches):
            out = []
            for t in ts:
                found = base_spans(t)
                rows = [{"kind": k, "start": s, "end": e, "base": True} for k, s, e in found]
                low, base, own = t.casefold(), _Taken(), [_Taken() for _ in KINDS]
                for _, s, e in sorted(found, key=lambda x: x[1:]):
                    base.join(s, e)
                for kind, cues, pattern in LOOSE:
                    if not cues or any(c in low for c in cues):
                        k = KINDS.index(kind)
                        for m in pattern.finditer(t):
                            s, e = m.span(m.lastindex or 0)
                            if base.free(s, e) and own[k].free(s, e):
                                own[k].put(s, e)
                                rows.append({"kind": k, "start": s, "end": e, "base": False})
                for r in rows:
                    v, r["shape"] = votes(KINDS[r["kind"]], t, r["start"], r["end"], r["base"])
                    r["votes"] = "".join(map(str, v))
                out.append(rows)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, _SPANS)], names=["doc_id", "spans"])

    return texts(docs).mapInArrow(freeing(run), "doc_id long, spans array<struct<kind:int,start:long,end:long,base:boolean,shape:int,votes:string>>")


_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("shape", pa.int32()), ("votes", pa.string())]))


def reliabilities(vote: np.ndarray, kind: np.ndarray, count: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """EM on vote patterns: (posterior of each pattern, P(vote | class) per labeler).

    Starts at the majority vote; add-one smoothing keeps unseen votes possible.
    """
    n = len(LABELERS)
    agree = (vote == 1).sum(1) - (vote == 0).sum(1)
    post = 1 / (1 + np.exp(-1.5 * agree))
    table = np.zeros((len(KINDS), n, 2, 3))
    for _ in range(rounds):
        like = np.zeros((len(vote), 2))
        for k in np.unique(kind):
            own = kind == k
            for c, p in ((0, 1 - post), (1, post)):
                w = count * p * own
                for j in range(n):
                    hit = np.bincount(vote[:, j], w, 3) + np.array([1.0 + (c == 0), 1.0 + (c == 1), 1.0])
                    table[k, j, c] = hit / hit.sum()
                prior = (w.sum() + 1) / ((count * own).sum() + 2)
                like[own, c] = np.log(prior) + np.log(np.stack([table[k, j, c][vote[own, j]] for j in range(n)])).sum(0)
        new = 1 / (1 + np.exp(np.clip(like[:, 0] - like[:, 1], -50, 50)))
        done = np.abs(new - post).max(initial=0) < 1e-6
        post = new
        if done:
            break
    return post, table


def features(vote: np.ndarray, kind: np.ndarray, shape: np.ndarray) -> np.ndarray:
    bits = [vote == 1, vote == 0, kind[:, None] == np.arange(len(KINDS)), (shape[:, None] >> np.arange(3)) & 1, np.ones((len(vote), 1))]
    return np.concatenate(bits, axis=1).astype(float)


def train_classifier(x: np.ndarray, post: np.ndarray, count: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of the logistic span classifier, by Newton steps on soft labels."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (count * (p - post)) + ridge * w
        hess = (x * (count * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): the spans of every document that are held to be personal.

    ``spans`` is sorted by kind as in ``KINDS``, then start; each has ``kind``,
    ``start``, ``end`` (code points, end exclusive), ``base`` and ``score``.
    """
    found = written(candidates(docs), "pii")
    counts = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.shape").count().orderBy("kind", "votes", "shape").collect()
    score: dict[tuple[int, str, int], float] = {}
    if counts:
        vote = np.array([[int(v) for v in r.votes] for r in counts])
        kind, shape, count = (np.array([r[i] for r in counts]) for i in (0, 2, 3))
        post, _ = reliabilities(vote, kind, count.astype(float))
        x = features(vote, kind, shape)
        p = 1 / (1 + np.exp(-np.clip(x @ train_classifier(x, post, count.astype(float)), -30, 30)))
        score = {(r.kind, r.votes, r.shape): float(v) for r, v in zip(counts, p, strict=True)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rows in batch.column(1).to_pylist():
                for r in rows:
                    r["score"] = score[r["kind"], r["votes"], r["shape"]]
                kept = [r for r in rows if r["base"] or r["score"] >= 0.5]
                out.append(sorted(kept, key=lambda r: (r["kind"], r["start"], r["end"])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _FOUND)], names=["doc_id", "spans"])

    return found.mapInArrow(run, "doc_id long, spans array<struct<kind:int,start:long,end:long,base:boolean,score:double>>")


_FOUND = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())]))
