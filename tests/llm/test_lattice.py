"""Decoding against all paths of short lattices, and long tokens."""

import itertools
import random
import time

import numpy as np
import pytest

from docloom.llm import toxicity as T

LEXICON = ["stupid", "idiot", "moron", "loser"]


@pytest.fixture(scope="module")
def model():
    text = " the cat sat on a mat and you are not a fool this is what they said to us about all of it " * 20
    c = T._CLASS[np.frombuffer(text.encode(), np.uint8)]
    corpus = np.bincount((c[:-2] * 28 + c[1:-1]) * 28 + c[2:], minlength=28**3).astype(float)
    return T.char_model(corpus, LEXICON)


def _score(path, costs, model):
    a, b, v = 0, 0, sum(costs)
    for c in [*path, 0]:
        v += model[a, b, c]
        a, b = b, c
    return v


@pytest.mark.parametrize("seed", range(60))
def test_decode_is_the_best_of_all_paths(model, seed):
    rng = random.Random(seed)
    spaced = seed % 2 == 0
    token = "".join(rng.choice("sstupidaeo0134$!6*") for _ in range(rng.randint(3, 6)))
    best = max(_score([c for said, _ in p for c in said], [k for _, k in p], model) for p in itertools.product(*T.lattice(token, spaced)))
    got = T.decode(token, model, spaced)
    scores = []
    # the decoded letters may be said in several ways; one of them has the best score
    for p in itertools.product(*T.lattice(token, spaced)):
        said = [c for x, _ in p for c in x]
        if "".join(chr(c + 96) if c else " " for c in said) == got:
            scores.append(_score(said, [k for _, k in p], model))
    assert scores and abs(max(scores) - best) < 1e-9


def _found(text, model):
    f = T.Findings({w.encode(): 1.0 for w in LEXICON}, model)
    return f.of(text)


@pytest.mark.parametrize("text", ["you $tup1d one", "you s t u p i d one", "what a m0r0n", "stuuuuupid", "stu" + "u" * 90 + "pid", "i d i o t", "a s t u p i d m o r o n", "y o u a r e a s t u p i d i d i o t", "x l.o.s.e.r y"])
def test_hidden_words_are_found(model, text):
    assert _found(text, model)[0] == 1.0


@pytest.mark.parametrize("text", ["a" * 10**6, "a1" * 300_000, "a " * 300_000, "!!" * 500_000, "ab" * 500_000, "aaa " * 250_000, "1 2 3 " * 100_000, "+" * 10**6])
def test_long_tokens_take_seconds(model, text):
    at = time.time()
    _found(text, model)
    assert time.time() - at < 15


def test_repeated_rows_and_ties(spark):
    docs = spark.createDataFrame([(1, "you stupid"), (1, "you stupid"), (None, None), (2, "fine day")] + [(i, f"you stupid w{i}" if i % 2 else f"fine day w{i}") for i in range(3, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(3, 60)] + [(3, 1), (3, None), (None, 1)], "doc_id long, toxic int")
    rows = T.score(docs, labels).collect()
    assert len(rows) == 61 and len({r.score for r in rows if r.doc_id == 1}) == 1
    by = {r.doc_id: r.score for r in rows}
    assert by[1] > 0.5 > by[2]
