"""Vectors of several lengths, workers without the package, texts of many spans."""

import os
import subprocess
import sys
import time

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import decontam, pii, pq_dedup

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_vectors_of_every_length_are_linked(spark, monkeypatch):
    monkeypatch.setattr(pq_dedup, "LENGTHS", 1)
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(40)] + [(100, [1.0, 0.0]), (101, [1.0, 0.01]), (102, [0.0, 1.0]), (103, [2.0, 0.0]), (200, [3.0]), (201, [5.0]), (202, [-1.0]), (300, [1.0, 0.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in pq_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    links = {i: [j for j in unit if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9] for i in unit}
    assert {i: n for i, (n, _) in got.items()} == {i: len(x) for i, x in links.items()}
    assert got[101] == (2, 100) and got[103][1] == 100 and got[201] == (1, 200) and got[202][1] == 202 and got[300] == (0, 300)


def test_tables_let_few_pairs_through(spark, monkeypatch):
    """What is re-ranked is a small part of what the searched lists hold."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 32))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = pq_dedup.unit(rows).select("node", "v", F.lit(1).alias("copies"))
    (dim, q), *_ = pq_dedup.fit(unit).items()
    v = x / np.linalg.norm(x, axis=1, keepdims=True)
    home = q.homes(v)
    residual = v - q.coarse[home]
    codes = q.encode(residual)
    most = (np.sqrt(0.2) + q.errors(residual, codes)) ** 2 + pq_dedup.ROUNDING
    seen = through = 0
    for k in range(len(q.coarse)):
        own = np.flatnonzero(home == k)
        near = q.distances(v[own] - q.coarse[k], codes[own]) <= most[own]
        seen, through = seen + near.size, through + int(near.sum())
    assert dim == 32 and through < 0.25 * seen


def test_workers_need_no_package(tmp_path):
    """The driver has the package on its own path only; its workers do not."""
    program = f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {str(tmp_path / "c")!r}).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
spark.range(1).mapInArrow(lambda b: b, "id long").collect()
sys.path.insert(0, {ROOT!r})
from pyspark.sql import functions as F
from docloom.llm import content_sort, hard_negatives, pq_dedup, prefix_trie
v = spark.createDataFrame([(i, [1.0, i % 3 / 9, 0.5], i % 2) for i in range(30)], "vec_id long, embedding array<double>, label int")
print("links", pq_dedup.near_duplicates(v).where("n_links > 0").count())
print("mined", hard_negatives.mine(v, F.col("label"), F.col("vec_id") % 10 == 0).count() > 0)
print("nodes", prefix_trie.trie(spark.createDataFrame([(1, 0, "a", "b")], "conv_id long, turn long, role string, text string")).count() >= 1)
print("kept", content_sort.exact_duplicates(spark.createDataFrame([(1, "a"), (2, "A")], "doc_id long, text string")).where("kept").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", program], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.split() == ["links", "30", "mined", "True", "nodes", "True", "kept", "1"], done.stderr[-3000:]


def test_many_spans_in_one_text(spark):
    """Time in proportion to the spans: 10,000 of several kinds in one text."""
    text = "call (555) 234-1234 or a1@b.com, 4111 1111 1111 1111 at 10.0.0.1, John Smith ssn 123-45-6789 "
    docs = spark.createDataFrame([(1, text * 2000)], "doc_id long, text string")
    pii.candidates(docs.limit(0)).count()
    began = time.time()
    (row,) = pii.candidates(docs).collect()
    assert len(row.spans) >= 10_000 and time.time() - began < 15
    taken = pii._Taken()
    rng = np.random.default_rng(0)
    held: list[tuple[int, int]] = []
    for s, n in zip(rng.integers(0, 500, 400).tolist(), rng.integers(1, 6, 400).tolist(), strict=True):
        free = not any(s < b and a < s + n for a, b in held)
        assert taken.free(s, s + n) == free
        if free:
            taken.put(s, s + n)
            held.append((s, s + n))


def test_proximity_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(14)]
    docs = [(i, " ".join(rng.choice(words, 60))) for i in range(30)] + [(99, " ".join(words))]
    items = [(k, " ".join(rng.choice(words, n, replace=False))) for k, n in enumerate((3, 4, 5, 6, 7))] + [(9, " ".join(words[2:6]))]
    got = {r.doc_id: r.near for r in decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=4, within=6).collect()}
    for d, t in docs:
        w = t.split()
        want = []
        for k, x in items:
            x = x.split()
            parts = [x[a : a + 4] for a in range(max(1, len(x) - 3))]
            if any(w[p] == part[0] and set(part) <= set(w[max(0, p - 6) : p + 7]) for part in parts for p in range(len(w))):
                want.append(k)
        assert sorted(got[d]) == want
