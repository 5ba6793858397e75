"""Links between isolated pairs of spread-out vectors, by band of cosine, and
what tasks give out."""

import numpy as np
import pytest

from docloom.llm import pq_dedup


def _pairs(n, dim, cosine, rng):
    a = rng.normal(size=(n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(n, dim))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return a, cosine * a + np.sqrt(1 - cosine**2) * b


@pytest.mark.parametrize("cosine", [0.9005, 0.92, 0.96])
def test_isolated_pairs_over_many_lists(spark, cosine):
    a, b = _pairs(4000, 64, cosine, np.random.default_rng(3))
    more = np.random.default_rng(4).normal(size=(4000, 64))
    v = np.concatenate([a, more, b])
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in pq_dedup.near_duplicates(rows).collect()}
    found = sum(got[8000 + i] == (1, i) and got[i] == (1, i) for i in range(4000))
    # 109 lists
    assert found >= 0.995 * 4000
    assert all(got[i] == (0, i) for i in range(4000, 8000))


def test_counts_and_components_equal_brute_force_over_lists(spark, monkeypatch):
    """Dense groups, copies and chunks smaller than lists."""
    monkeypatch.setattr(pq_dedup, "CHUNK", 50)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 16))
    v = np.concatenate([base[rng.integers(0, 40, 900)] + 0.25 * rng.normal(size=(900, 16)), np.repeat(base[:2], 30, 0), rng.normal(size=(300, 16))])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    n = near.sum(1) - 1
    label = np.arange(len(v))
    for _ in range(50):
        label = np.where(near, label[None, :], len(v)).min(1)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in pq_dedup.near_duplicates(rows, reach=99.0).collect())
    assert got == [(i, int(n[i]), int(label[i])) for i in range(len(v))]
    got = {r.vec_id: r.n_links for r in pq_dedup.near_duplicates(rows).collect()}
    assert all(got[i] <= n[i] for i in got) and sum(got.values()) >= 0.99 * n.sum()


def test_forest():
    up = pq_dedup._joined(np.arange(9), np.array([5, 0, 3, 7]), np.array([6, 5, 8, 8]))
    assert up.tolist() == [0, 1, 2, 3, 4, 0, 0, 3, 3]


def test_ties_in_the_fitted_sample(spark):
    rows = spark.createDataFrame([(i % 3, [1.0, float(i % 2)], 1) for i in range(40)], "vec_id long, embedding array<double>, node int")
    got = {(r.vec_id, r.n_links, r.component_id) for r in pq_dedup.near_duplicates(rows, fit_rows=1).collect()}
    assert got == {(i, 19, 0) for i in range(3)}
