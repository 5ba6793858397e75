"""Duplicates of embeddings, substrings and documents, and mixing: against brute force."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import components, minhash, mixing, pq_dedup, rlz_dedup
from docloom.llm import queries as Q
from tests.compare import rows_equal

SF = "/root/testdata/sf0.01"


def _roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(0)
    path = [(i, i + 1) for i in range(40)]
    star = [(100, 101 + i) for i in range(50)]
    loose = [(int(a) + 300, int(b) + 300) for a, b in rng.integers(0, 60, (40, 2))]
    links = path + star + loose + [(7, 7), (3, 2)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for p in links for x in p if p[0] != p[1]}
    assert got == _roots(nodes, links)


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(150, 32))
    x = np.concatenate([base, base[:60] + 0.05 * rng.normal(size=(60, 32)), np.repeat(base[:1], 40, 0), base[70:71] + 0.04 * rng.normal(size=(50, 32))])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = {(i, j) for i, j in zip(*np.nonzero(u @ u.T >= 0.9), strict=True) if i < j}
    rows = pq_dedup.near_duplicates(df).collect()
    assert sum(r.n_links for r in rows) >= 2 * 0.98 * len(links)
    assert sum(r.n_links for r in rows) <= 2 * len(links)
    root = _roots(range(len(x)), links)
    assert np.mean([root[r.vec_id] == r.component_id for r in rows]) > 0.98


def test_embeddings_recall_on_the_table(spark):
    rows_equal(Q.op5_embedding_dedup(spark, SF), Q.ORACLES["op5_embedding_dedup"], SF)


def test_embedding_edges(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (None, [1.0, 0.0]), (7, [1.0, None]), (8, [1.0, 0.0, 1.0]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in pq_dedup.near_duplicates(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5), None: (0, None), 7: (0, 7), 8: (0, 8), 9: (0, 9)}
    assert pq_dedup.near_duplicates(df.limit(0)).count() == 0


def _windows(docs, window):
    seen, out = set(), []
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        w = (t or "").split(" ") if t else []
        gone = [0] * len(w)
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            if g in seen:
                gone[k : k + window] = [1] * window
            seen.add(g)
        out.append((d, len(w), sum(gone), " ".join(a for a, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("reference_bytes", "bucket_bytes", "hot"), [(1 << 20, 1 << 20, 1.0), (60, 1 << 20, 0.02), (60, 100, 1.0), (300, 100, 1e-9)])
def test_substrings_equal_loops(spark, reference_bytes, bucket_bytes, hot):
    rng = np.random.default_rng(1)
    docs = [(int(i), " ".join(rng.choice(["a", "b"], rng.integers(1, 40)))) for i in range(80)]
    docs += [(None, docs[5][1]), (200, None), (201, ""), (202, " ".join(["b"] * 30_000))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rlz_dedup.dedup(df, 6, 3, reference_bytes, bucket_bytes, hot).collect()), key=str)
    assert got == _windows(docs, 6)


def test_substrings_equal_sql(spark):
    rows_equal(Q.op7_substring_dedup(spark, SF), Q.ORACLES["op7_substring_dedup"], SF)


def test_identical_rows_keep_one(spark):
    rows = [(1, "a b c d e f g h")] * 3 + [(0, "b c d e f g")]
    got = sorted(r.kept for r in rlz_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 6, 3).collect())
    assert got == ["", "", "a h", "b c d e f g"]
    assert rlz_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").limit(0)).count() == 0


def test_hot_runs_are_dealt_out_by_window(spark):
    """One line in all documents: no bucket holds most windows under its anchor."""
    line = "the very same line of twelve words stands in every document here".split()
    docs = [(i, " ".join([*(f"a{i}x{j}" for j in range(30)), *line, *(f"b{i}x{j}" for j in range(30))])) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    often, size = rlz_dedup.hot_runs(df, hot=0.005)
    assert len(often) == 12 - rlz_dedup.ANCHOR + 1 and size == sum(len(t) for _, t in docs)
    index = rlz_dedup._digested(df).mapInArrow(rlz_dedup._index(20, 6, 1 << 20, 16, spark.sparkContext.broadcast(often)), "bucket int, data binary")
    load = [r.n for r in index.groupBy("bucket").agg(F.sum(F.length("data")).alias("n")).collect()]
    assert len(load) == 16 and max(load) < 2 * sum(load) / 16
    assert sum(r.n_removed for r in rlz_dedup.dedup(df, hot=0.005).collect()) == 0


def test_factors_are_greedy():
    m = [{"start": 0, "many": 3, "ref_doc": 1, "ref_start": 5}, {"start": 3, "many": 1, "ref_doc": 1, "ref_start": 8}, {"start": 4, "many": 2, "ref_doc": 2, "ref_start": 0}]
    assert rlz_dedup.factors(m, 4) == [(0, 7, 1, 5), (4, 9, 2, 0)]


def _brute_classes(rows, idf):
    """Class per row of (id, text) by all pairs that share a shingle."""
    vec = [(h, n * (1 + idf.of(h) / minhash.STEPS)) for h, n, _ in minhash.shingles([t or "" for _, t in rows])]
    post, common = defaultdict(list), defaultdict(float)
    for i, (h, w) in enumerate(vec):
        for a, b in zip(h.tolist(), w.tolist(), strict=True):
            for j, c in post[a]:
                common[j, i] += min(b, c)
            post[a].append((i, b))
    total = [float(w.sum()) for _, w in vec]
    root = _roots(range(len(rows)), [(i, j) for (i, j), m in common.items() if m / (total[i] + total[j] - m) >= 0.8 - 1e-9])
    least = defaultdict(lambda: 1 << 62)
    for i, (d, _) in enumerate(rows):
        least[root[i]] = min(d, least[root[i]])
    return [least[root[i]] for i in range(len(rows))]


def test_minhash_equals_brute_force(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()}
    idf = minhash.weights(df, minhash.nodes_and_candidates(df))
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").orderBy("doc_id").collect()]
    assert got == {d: c for (d, _), c in zip(rows, _brute_classes(rows, idf), strict=True)}


def test_word_hashes_tell_words_apart():
    from docloom.llm.decontam import words

    rng = np.random.default_rng(0)
    letters = "abcAB12 ,.é-\n"
    ts = ["".join(rng.choice(list(letters), rng.integers(0, 60))) for _ in range(300)] + ["", " ", "a", "ab ba aab aba baa", "x" * 10**6]
    h, many = minhash.word_hashes(ts)
    w = [words(t) for t in ts]
    assert many.tolist() == [len(x) for x in w]
    flat = [x for d in w for x in d]
    assert len(set(zip(flat, h.tolist(), strict=True))) == len(set(flat)) == len(set(h.tolist()))
    assert minhash.word_hashes([])[1].tolist() == [] and minhash.word_hashes(["é"])[1].tolist() == [1]


def test_frequencies_of_common_shingles_are_exact(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").repartition(7)
    idf = minhash.weights(df, minhash.nodes_and_candidates(df, block_bytes=50_000), block_bytes=90_000)
    own = [h for h, _, _ in minhash.shingles([r.text or "" for r in df.collect()])]
    n = sum(len(h) > 0 for h in own)
    grams, df_ = np.unique(np.concatenate(own), return_counts=True)
    keep = df_ >= minhash.COMMON * n
    assert keep.sum() > 100 and (idf.grams == grams[keep]).all()
    assert (idf.steps == np.round(15 * np.clip(np.log(n / df_[keep]) / np.log(100), 0, 1))).all()


@pytest.mark.parametrize("chunk", [(4 << 20, 2048), (3000, 5)])
def test_buckets_of_any_size_lose_no_link(spark, monkeypatch, chunk):
    """A group of edited copies, far from one another as a rule; chunks change nothing."""
    rng = np.random.default_rng(11)
    w = rng.integers(0, 10**6, 120)
    docs = []
    for i in range(60):
        x = w.copy()
        x[rng.random(120) < rng.uniform(0, 0.12)] = rng.integers(10**7)
        docs.append((i, " ".join(map(str, x))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    real = minhash.between_classes
    monkeypatch.setattr(minhash, "between_classes", lambda known, body, threshold: real(known, body, threshold, *chunk))
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()}
    idf = minhash.weights(df, minhash.nodes_and_candidates(df))
    want = _brute_classes(docs, idf)
    assert len(set(want)) > 5
    # links are found with probability 0.995 and more
    assert sum(got[d] != c for (d, _), c in zip(docs, want, strict=True)) <= 2


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(5, a), (5, b), (2, b), (7, a), (9, " ".join(f"w{i}" for i in range(200_000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id) for r in minhash.near_duplicates(df).collect())
    assert got == [(2, 2), (5, 2), (5, 5), (7, 5), (9, 9)]


def test_weighted_samples_estimate_similarity():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = (h[:300], rng.uniform(1, 3, 300)), (h[60:], None)
    w = dict(zip(a[0].tolist(), a[1].tolist(), strict=True))
    b = (h[60:], np.array([w.get(x, 1.5) for x in h[60:].tolist()]))
    common = sum(w[x] for x in h[60:300].tolist())
    true = common / (a[1].sum() + b[1].sum() - common)
    r_of = minhash.gamma_quantiles()
    same = []
    for k in range(40):
        shift = np.uint64(k * 7919)
        s = minhash.samples(np.concatenate([a[0], b[0]]) + shift, np.concatenate([a[1], b[1]]), np.array([0, len(a[0])]), r_of)
        same.append((s[0] == s[1]).mean())
    assert abs(np.mean(same) - true) < 0.03


def test_minhash_edges(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A, b!"), (None, "a b"), (5, "x y z"), (6, "x  y Z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class", F.lit(1))
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()} == {1: 1, 2: 2, 3: 3, 4: 3, None: None, 5: 5, 6: 5}
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_classes_join_through_a_chain(spark):
    rng = np.random.default_rng(3)
    w = [f"w{i}" for i in rng.integers(0, 10**6, 200)]
    docs = []
    for i in range(12):
        docs.append((i, " ".join(w)))
        w = [*w]
        w[(i * 16) % 200] = f"new{i}"
    df = spark.createDataFrame([*docs, (99, " ".join(f"z{i}" for i in range(200)))], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()} == {**{i: 0 for i in range(12)}, 99: 99}


def test_mix_equals_sql(spark):
    rows_equal(Q.op8_source_mix(spark, SF), Q.ORACLES["op8_source_mix"], SF)


def _edf(units, blocks):
    """[(source, block, slot)] by the plain rule."""
    total, had, t, out = sum(units), [0] * len(units), 0, []
    while any(h < b for h, b in zip(had, blocks, strict=True)):
        t = max(t, min(h * total // u for u, h, b in zip(units, had, blocks, strict=True) if h < b))
        p = min(((had[i] + 1) * total + u - 1) // u * 1000 + i for i, u in enumerate(units) if had[i] < blocks[i] and had[i] * total // u <= t) % 1000
        out.append((p, had[p], t))
        had[p], t = had[p] + 1, t + 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_schedule_equals_loops(spark, seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 12))
    units, blocks = rng.integers(1, 5000, n).tolist(), rng.integers(1, 90, n).tolist()
    rows = spark.createDataFrame([(f"s{i:02}", u, b) for i, (u, b) in enumerate(zip(units, blocks, strict=True))], "source string, unit long, blocks long")
    got = sorted((r.slot, int(r.source[1:]), r.block) for r in mixing.schedule(rows).collect())
    assert got == [(t, p, k) for p, k, t in _edf(units, blocks)]


def test_mix_deviates_less_than_a_block_from_unrounded_weights(spark):
    """A hot source of a third, others of very uneven sizes."""
    other = F.concat(F.lit("s"), F.floor(F.pow(F.rand(5), 3) * 19).cast("int").cast("string"))
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(other).alias("source"), F.lit("x").alias("text"))
    docs = spark.createDataFrame(docs.toPandas())
    rows = mixing.mixed(docs, block_rows=4).collect()
    assert all(r.release <= r.slot < r.deadline for r in rows)
    assert len({(r.slot, r.place) for r in rows}) == len(rows) == 40_000
    by, n = defaultdict(list), defaultdict(int)
    for r in rows:
        by[r.source].append((r.doc_id, 4 * r.block + r.place))
        n[r.source] += 1
    assert all([k for _, k in sorted(v)] == list(range(len(v))) for v in by.values())
    unit = {s: int(np.floor(np.sqrt(k) * 1000)) for s, k in n.items()}
    share = {s: u / sum(unit.values()) for s, u in unit.items()}
    slots = sorted({(r.slot, r.source) for r in rows})
    until = min(max(t for t, s in slots if s == x) for x in n)
    had = defaultdict(int)
    for k, (t, s) in enumerate(slots):
        if t >= until:
            break
        assert k == t
        had[s] += 1
        assert all(abs(had[x] - share[x] * (t + 1)) < 1 for x in n)
    assert until > 300


def test_mix_given_weights_and_edges(spark):
    docs = spark.createDataFrame([(i, "t", s, 5) for i, s in enumerate("aaaabbbb")] + [(None, None, None, 5), (1, "t", "c", 5)], "doc_id long, text string, source string, slot int")
    weights = spark.createDataFrame([("a", 3), ("b", 1)], "source string, unit long")
    rows = mixing.mixed(docs, weights, block_rows=1).orderBy("slot", "place").collect()
    assert len(rows) == 10 and [r.source for r in rows if r.source in ("a", "b")][:5].count("a") >= 3
    assert max(r.place for r in mixing.mixed(docs, weights, block_rows=1, slots=3).collect()) == 3
    assert mixing.mixed(docs.limit(0)).count() == 0 and mixing.in_order(docs).columns == docs.columns
    many = spark.range(300).selectExpr("cast(id as string) as source", "1L as unit", "1L as blocks")
    assert mixing.schedule(many).count() == 300
