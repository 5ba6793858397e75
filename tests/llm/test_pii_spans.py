"""Base patterns against the plain rules, long texts, and added spans against planted ones."""

import random
import re
import time

import pytest

from docloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _plain(t):
    out = [(0, m.start(), m.end()) for m in EMAIL.finditer(t)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append((2, m.start(), m.end()))
    return out + [(3, m.start(), m.end()) for m in PHONE.finditer(t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


@pytest.mark.parametrize("seed", range(40))
def test_base_spans_equal_the_rules(seed):
    rng = random.Random(seed)
    for alphabet in ("a@.-", "a1@. ", "0123.", "12. ", "+1() .-9", "4 -0123456789"):
        for _ in range(60):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert pii.base_spans(t) == _plain(t), t


@pytest.mark.parametrize("text", ["a" * 10**6 + " b@c.d", "1" * 10**6, "1.2.3." + "9" * 5000, "1.2.3." + "0" * 5000 + "7", "1." * 500_000, "a.b@" * 250_000, "+1" + " " * 10**6, "token " * 100_000 + "name [at]", "x" * 10**6 + "[at]", "key" + " " * 10**6])
def test_long_texts_take_seconds(spark, text):
    at = time.time()
    rows = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert len(rows) == 1 and time.time() - at < 15
    if text.startswith("1.2.3.0"):
        assert [s.kind for s in rows[0].spans] == [1]


def test_added_spans_are_found(spark):
    """Planted names, numbers and secrets in noise, and look-alikes that are none."""
    rng = random.Random(3)
    noise = lambda n: " ".join(rng.choice("the and of river mountain Some thing went over there before Noon".split()) for _ in range(n))
    plant = {
        "name": lambda: f"my name is {rng.choice(['Anna', 'Peter', 'Zelda', 'Oleg'])} {rng.choice(['Novak', 'Smith', 'Okafor'])}",
        "ssn": lambda: f"social security {rng.randint(100, 600)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}",
        "secret": lambda: f'api_key = "{rng.randbytes(20).hex()}"',
        "phone": lambda: f"call ({rng.randint(200, 900)}) {rng.randint(200, 900)}-{rng.randint(1000, 9999)}",
    }
    decoys = {"ssn": lambda: "part 000-00-0000 order", "secret": lambda: "secret: aaaaaaaaaaaaaaaaaaaaaaaa", "phone": lambda: "version 111.111.1111"}
    docs, want = [], []
    for i in range(600):
        kind = rng.choice([*plant, None, *(f"no {k}" for k in decoys)])
        said = "" if kind is None else decoys[kind[3:]]() if kind.startswith("no ") else plant[kind]()
        docs.append((i, f"{noise(20)} {said} {noise(20)}"))
        want.append(kind if kind in plant else None)
    rows = {r.doc_id: {pii.KINDS[s.kind] for s in r.spans} for r in pii.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    hit = sum(w in rows[i] for i, w in enumerate(want) if w)
    wrong = sum(bool(rows[i] - {w}) for i, w in enumerate(want))
    assert hit / sum(w is not None for w in want) >= 0.95
    assert wrong / max(1, hit + wrong) <= 0.1, [(docs[i], rows[i]) for i, w in enumerate(want) if rows[i] - {w}][:5]
