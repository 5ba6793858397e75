"""Hard negatives against all pairs in plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import hard_negatives
from docloom.llm import queries as Q
from tests.compare import rows_equal

SCHEMA = "vec_id long, embedding array<double>, label int"


def _want(rows, k=5, low=80, every=10):
    own = {}
    for i, e, label in rows:
        if i is None or label is None or not e or any(x is None or not np.isfinite(x) for x in e):
            continue
        new = (label, len(e), tuple(int(np.floor(256 * x)) for x in e))
        own[i] = min(own.get(i, new), new)
    out = []
    for a, (label, d, v) in own.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), b, l) for b, (l, e, w) in own.items() if b != a and e == d)
        positives = [(b, -s) for s, b, l in scored if l == label][:k]
        for b, top in positives:
            found = [(c, -s) for s, c, l in scored if l != label and low * top <= -100 * s <= 100 * top][:k]
            out += [(a, b, n + 1, c, top, s) for n, (c, s) in enumerate(found)]
    return sorted(out)


def _check(spark, rows, **more):
    got = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("label"), F.col("vec_id") % 10 == 0, **more)
    want = _want(rows)
    assert sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got.collect()) == want
    return len(want)


def _clustered(n=600, dim=12, spread=0.25, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = centres[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, dim))
    # a fifth are copies of one vector
    x[rng.random(n) < 0.2] = x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, v.tolist(), int(label)) for i, (v, label) in enumerate(zip(x, rng.integers(0, 3, n), strict=True))]


@pytest.mark.parametrize("probe", [5, 200, 100_000])
def test_equals_all_pairs(spark, probe, monkeypatch):
    monkeypatch.setattr(hard_negatives, "CHUNK", 40)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 7)
    monkeypatch.setattr(hard_negatives, "CELL_ROWS", 6)
    assert _check(spark, _clustered(), probe_rows=probe) > 200


def test_heap_goes_down():
    rng = np.random.default_rng(0)
    one, two = rng.integers(0, 9, 7).astype(float), rng.integers(0, 9, 5).astype(float)
    got = list(hard_negatives.descending(one, two))
    sums = [s for s, _, _ in got]
    assert sums == sorted(sums, reverse=True) and len({(i, j) for _, i, j in got}) == 35
    assert all(s == one[i] + two[j] for s, i, j in got)
    mask = hard_negatives.cells_above(one, two, 9.0)
    assert {(i, j) for s, i, j in got if s >= 9.0} == set(zip(*np.nonzero(mask), strict=True))


def test_cells_that_are_left_out_hold_nothing_of_use():
    """Of well separated clusters most cells are not visited, and every bound holds."""
    rng = np.random.default_rng(1)
    centres = np.repeat(np.eye(8) * 900.0, 2, axis=0)
    x = np.floor(centres[rng.integers(0, 16, 2000)] + rng.normal(size=(2000, 8)) * 20)
    books = (hard_negatives.kmeans(x[:, :4], 8), hard_negatives.kmeans(x[:, 4:], 8))
    (i, far1), (j, far2) = hard_negatives._nearest(x[:, :4], books[0]), hard_negatives._nearest(x[:, 4:], books[1])
    rows = {}
    for a, b, r1, r2 in zip(i, j, far1, far2, strict=True):
        n, m1, m2 = rows.get((a, b), (0, 0.0, 0.0))
        rows[a, b] = (n + 1, max(m1, r1), max(m2, r2))
    cells = hard_negatives._Cells(books, [(a, b, *v) for (a, b), v in rows.items()])
    for q in x[:20]:
        score = x @ q
        least = np.sort(score)[-50]
        mask = cells.down_to(q, least)
        assert set(zip(i[score >= least], j[score >= least], strict=True)) <= set(zip(*np.nonzero(mask), strict=True))
        assert cells.n[mask].sum() < 1000


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    v = [0.5, 0.5, 0.5, 0.5]
    rows = [(0, v, 1), (1, v, 1), (2, v, 0), (3, None, 1), (4, [nan, 1.0, 0.0, 0.0], 1), (5, [inf, 1.0, 0.0, 0.0], 0), (6, [None, 1.0, 0.0, 0.0], 0), (7, v, None), (None, v, 0), (8, [0.4, 0.5, 0.5, 0.5], 0), (9, [1.0, 0.0], 1), (10, [1.0, 0.1], 1), (11, [1.0, 0.2], 0), (20, [-1.0, 0.0], 1), (21, [], 1), (2, v, 0), (2, [0.1, 0.1, 0.1, 0.1], 2), (30, [1e5, 2e6, -3.0, 4.0], 1), (31, [1e5, 2e6, 0.0, 4.0], 1), (32, [9e4, 2e6, 0.0, 4.0], 0), (40, [0.0, 0.0, 0.0, 0.0], 5), (41, [0.7], 5), (50, [0.7], 5), (51, [0.7], 6)]
    assert _check(spark, rows) > 0
    table = spark.createDataFrame(rows, SCHEMA)
    mined = lambda t: hard_negatives.mine(t, F.col("label"), F.col("vec_id") % 10 == 0)
    assert mined(table.limit(0)).count() == 0 and mined(table.where("vec_id = 1")).count() == 0
    plain = sorted(map(repr, mined(table).collect()))
    extra = table.withColumns({c: F.lit("x") for c in ("v", "d", "i", "j", "e", "m", "q", "least", "tops", "codes", "member", "far1", "anchor_id", "top", "score", "rank")})
    assert sorted(map(repr, mined(extra).collect())) == plain


def test_equals_sql(spark):
    rows_equal(Q.op12_hard_negatives(spark, "/root/testdata/sf0.01"), Q.ORACLES["op12_hard_negatives"], "/root/testdata/sf0.01")
