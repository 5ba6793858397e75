"""Ranking operators against plain loops."""

import hashlib
import os
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from docloom.operators import graph, lexical, search, vector_index
from docloom.plans import change_queries  # noqa: F401
from docloom.plans.registry import QUERIES
from docloom.sources import files


def _candidates(spark, n=30, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    rows = [(1, i, float(s), i + 1, x[i].tolist()) for i, s in enumerate(sorted(rng.random(n).round(6), reverse=True))]
    return spark.createDataFrame(rows, "query_id long, chunk_id long, score double, rank int, embedding array<double>"), x, [r[2] for r in rows]


def test_mmr_equals_a_loop(spark):
    df, x, score = _candidates(spark)
    got = [r.chunk_id for r in search.mmr(df, 6, 0.7).orderBy("mmr_rank").collect()]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    left, want = list(range(len(x))), []
    while len(want) < 6:
        v = [0.7 * score[i] - 0.3 * max([float(u[i] @ u[j]) for j in want], default=0.0) for i in left]
        want.append(left.pop(int(np.argmax(np.round(v, 9)))))
    assert got == want


def test_mmr_without_diversity_is_the_ranking(spark):
    df, _, _ = _candidates(spark)
    assert [r.chunk_id for r in search.mmr(df, 5, 1.0).orderBy("mmr_rank").collect()] == list(range(5))


def test_diversify_limits_documents(spark):
    rows = [(1, i, i // 6, i + 1) for i in range(24)]
    df = spark.createDataFrame(rows, "query_id long, chunk_id long, document_id long, rank int")
    got = [r.document_id for r in search.diversify(df, 12, 3).orderBy("final_rank").collect()]
    assert got == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 3]
    assert [r.chunk_id for r in search.diversify(df, 15, 3).orderBy("final_rank").collect()][12:] == [3, 4, 5]


def test_query_blocks_cover_all(spark):
    q = spark.range(50).withColumnRenamed("id", "query_id")
    parts = [[r.query_id for r in b.collect()] for b in search.query_blocks(q, 9)]
    assert len(parts) == 6 and sorted(sum(parts, [])) == list(range(50))


def test_hops_and_shared_limit(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (2, 1)], "src long, dst long").withColumns({"type": F.lit("CITES"), "count": F.lit(None).cast("long"), "strength": F.lit(None).cast("double")})
    seeds = spark.createDataFrame([(0, 7, 1)], "query_id long, user_id long, document_id long")
    may = spark.createDataFrame([(7, 1), (7, 3), (8, 2)], "user_id long, document_id long")
    assert graph.expand_hops(seeds, e, may, 2).count() == 0
    assert {(r.document_id, r.hop) for r in graph.expand_hops(seeds, e, hops=2, enforce_acl=False).collect()} == {(2, 1), (3, 2)}
    m = spark.createDataFrame([(d, n) for d in range(4) for n in ("a", "b")] + [(9, "c"), (8, "c")], "document_id long, name string")
    assert graph.shared(m, "name", 1, 2).count() == 1 and graph.shared(m, "name", 2).count() == 6
    whole = sorted(map(str, graph.shared(m, "name", 1).collect()))
    assert whole == sorted(map(str, graph.shared(m, "name", 1, chunk=2).collect())) == sorted(map(str, graph.shared(m, "name", 1, chunk=1).collect()))


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, doc_id long, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, doc_id long, rank int")
    assert [r.doc_id for r in lexical.fuse(a, b).orderBy("rank").collect()] == [11, 10, 12]


def test_feed_pages_and_listing(spark, tmp_path):
    page = '{"value":[{"id":"1","name":"a.pdf","cTag":"c","eTag":"e","lastModifiedDateTime":"2024-01-01T00:00:00Z","parentReference":{"driveId":"d","path":"/p"},"file":{"mimeType":"x"},"lastModifiedBy":{"user":{"displayName":"N"}}},{"id":"2","deleted":{"state":"deleted"}},{"id":"3","folder":{"childCount":1}}],"@odata.nextLink":"n"}'
    (tmp_path / "feed").mkdir()
    (tmp_path / "feed" / "1.json").write_text(page)
    rows = files.feed(spark, str(tmp_path / "feed")).orderBy("position").collect()
    assert [(r.item_id, r.is_deleted, r.is_folder) for r in rows] == [("1", False, False), ("2", True, False), ("3", False, True)]
    assert rows[0].modified_by == "N" and rows[0].modified_at is not None
    (tmp_path / "d" / "e").mkdir(parents=True)
    for n in ("x.PDF", "y.txt", "e/z.docx"):
        (tmp_path / "d" / n).write_bytes(b"hi")
    assert {r.name for r in files.listing(spark, str(tmp_path / "d")).collect()} == {"x.PDF", "z.docx"}
    assert files.fingerprints(spark, str(tmp_path / "d")).count() == 3


def test_access_is_required(spark):
    import pytest

    chunks = spark.createDataFrame([(i, i % 3, [float(i), 1.0]) for i in range(9)] + [(9, 0, None), (10, 0, [0.0, 0.0]), (11, 0, [1.0])], "chunk_id long, document_id long, embedding array<float>")
    q = spark.createDataFrame([(1, 7, [1.0, 1.0], None), (2, 8, [1.0, 0.0], None), (3, None, [1.0, 0.0], None)], "query_id long, user_id long, embedding array<float>, department string")
    may = spark.createDataFrame([(7, 1), (8, 0), (8, 0)], "user_id long, document_id long")
    with pytest.raises(ValueError, match="access"):
        search.scored(q, chunks)
    got = {(r.query_id, r.document_id) for r in search.scored(q, chunks, may).collect()}
    assert got == {(1, 1), (2, 0)}
    assert search.scored(q, chunks, enforce_acl=False).count() == 27
    with pytest.raises(ValueError, match="access"):
        search.nearest(q, chunks)
    for own in ({"enforce_acl": False}, {"access": may}):
        best, every = search.nearest(q, chunks, k=2, **own), search.top_k(search.scored(q, chunks, **own), 2)
        assert sorted(map(str, best.select(*every.columns).collect())) == sorted(map(str, every.collect()))
    assert search.scored(q.limit(0), chunks, may).count() == 0 and search.scored(q, chunks.limit(0), may).count() == 0


def _clustered(spark, n, lists=40, dim=24):
    import numpy as np

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(lists, dim))
    rows = [(i, i % 5, (centres[i % lists] + 0.5 * rng.normal(size=dim)).tolist()) for i in range(n)]
    chunks = spark.createDataFrame(rows, "chunk_id long, document_id long, embedding array<float>")
    return chunks, chunks.where("chunk_id % 100 = 0").selectExpr("chunk_id as query_id", "1L as user_id", "embedding", "cast(null as string) as department")


def test_tasks_give_out_k_rows_a_query(spark, monkeypatch):
    chunks, q = _clustered(spark, 3000)
    q = q.limit(20).cache()
    found = search.block_best(q, chunks.repartition(3), None, 5)
    assert found.count() <= 3 * 20 * 5
    assert set(found.columns) == {"query_id", "chunk_id", "score"}
    pairs = lambda df: sorted((r.query_id, r.rank, r.chunk_id, r.score) for r in df.collect())
    want = pairs(search.top_k(search.scored(q, chunks, enforce_acl=False), 5))
    assert pairs(search.nearest(q, chunks, k=5, enforce_acl=False)) == want
    # several blocks of queries are searched one after the other
    blocks = search.query_blocks
    monkeypatch.setattr(search, "query_blocks", lambda queries: blocks(queries, 6))
    assert pairs(search.nearest(q, chunks, k=5, enforce_acl=False)) == want


def test_best_keeps_ties_by_id():
    import numpy as np

    rng = np.random.default_rng(0)
    score = rng.integers(0, 6, (500, 3)) / 10
    score[rng.random(score.shape) < 0.2] = np.nan
    ids = rng.permutation(500)
    best = search.Best(3, 7)
    for k in range(0, 500, 13):
        best.add(score[k : k + 13], ids[k : k + 13])
    query, own, value = best.cut()
    want = [(c, i, s) for c in range(3) for s, i in sorted(((s, i) for s, i in zip(score[:, c], ids, strict=True) if s == s), key=lambda x: (-x[0], x[1]))[:7]]
    assert [(a, b, c) for a, b, c in zip(query.tolist(), own.tolist(), value.tolist(), strict=True)] == want


def test_stored_index(spark, tmp_path):
    """Recall of at least 0.95 at less than a tenth of the rows over 100 lists and more, by
    a search that knows only the path, and lists pruned from the scan at run time."""
    chunks, q = _clustered(spark, 12_000, 100)
    path = str(tmp_path / "index")
    vector_index.build(chunks.unionByName(spark.createDataFrame([(-1, 0, None), (-2, 0, [0.0] * 24)], chunks.schema)), path)
    assert spark.read.parquet(f"{path}/centres").count() >= 100 and vector_index.index_exists(spark, path)
    assert vector_index.share_read(path, q, 6).selectExpr("max(share)").first()[0] < 0.1
    got = {(r.query_id, r.chunk_id) for r in vector_index.search(path, q, None, 10, 6, enforce_acl=False).collect()}
    exact = {(r.query_id, r.chunk_id) for r in search.nearest(q, chunks, k=10, enforce_acl=False).collect()}
    assert len(got & exact) >= 0.95 * len(exact)
    rows, _ = vector_index.visited(q.limit(1), path, 3)
    assert 0 < rows.count() < 1200
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    may = spark.createDataFrame([(1, 3)], "user_id long, document_id long")
    assert {r.document_id for r in vector_index.search(path, q, may, 5, 6).collect()} == {3}


def test_bm25_keeps_words_and_pairs_in_tasks(spark):
    said = ["a b c", "B, b; a", "", None, "é c d\nc", "kk 1 a-a", " x y ", "a b c"]
    docs = spark.createDataFrame([(i, said[i % 8]) for i in range(400)], "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame([(0, "a b"), (100, "C zzz c"), (200, "..."), (300, None), (400, "x d kk")], "query_id long, text string")
    got = lexical.bm25(queries, docs, 5)
    assert "explode" not in got._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: sorted(map(tuple, df.select("query_id", "doc_id", "score", "rank").collect()))
    assert len(rows(got)) == 15
    assert rows(got) == rows(lexical._joined(queries, docs, 5, 1.2, 0.75))


def test_best_sends_on_few_of_a_slice():
    import numpy as np

    score = np.round(np.random.default_rng(0).random((5000, 3)), 2)
    score[:, 1] = np.nan
    score[:2, 1] = 0.5
    best = search.Best(3, 4)
    best.add(score, np.arange(5000))
    assert best.held < 500
    query, own, value = best.cut()
    want = [(q, i, score[i, q]) for q in range(3) for i in sorted((i for i in range(5000) if score[i, q] == score[i, q]), key=lambda i: (-score[i, q], i))[:4]]
    assert list(zip(query, own, value, strict=True)) == want


def test_hybrid_fusion_has_the_lexical_ranking_of_tasks(spark):
    from docloom.plans.registry import QUERIES

    df = QUERIES["hybrid_fusion"](spark, "/root/testdata/sf0.001")
    assert "explode" not in df._jdf.queryExecution().executedPlan().toString()


def test_landed_rows(spark, tmp_path):
    """Each row is a file, few files are in a folder, and what a lost attempt has left is not
    listed; on another file system than the local one Spark writes the files."""
    rows = spark.createDataFrame([(f"{i % 40} \u00e9\n",) for i in range(57)] + [("",)], "text string").coalesce(2)
    want = Counter(hashlib.sha256((r.text + "\n").encode()).hexdigest() for r in rows.collect())
    path = f"file://{tmp_path}/landed"
    folders = files.land(rows, path, 10)
    names = [os.listdir(f.removeprefix("file:")) for f in folders]
    assert sum(map(len, names)) == 58 and max(map(len, names)) == 10 and not any(n.endswith(".crc") for f in names for n in f)
    os.mkdir(tmp_path / "landed" / "lost")
    (tmp_path / "landed" / "lost" / "00000.txt").write_text("lost")
    found = files.listed(spark, folders, ["txt"], most=2).collect()
    assert Counter(r.content_hash for r in found) == want and len({(r.drive_id, r.item_id) for r in found}) == 58
    assert files.listed(spark, files.land(rows.limit(0), f"file://{tmp_path}/none"), ["txt"]).count() == 0
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.landed.link./to", f"file://{tmp_path}")
    assert Counter(r.content_hash for r in files.listed(spark, files.land(rows, "viewfs://landed/to/remote", 10), ["txt"]).collect()) == want


def test_documents_land_in_folders(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    known = set(os.listdir(base))
    assert QUERIES["landed_files"](spark, "/root/testdata/sf0.01").agg(F.sum("n")).first()[0] == 1000
    assert QUERIES["landed_pages"](spark, "/root/testdata/sf0.01").count() > 0
    for name in ("files", "pages"):
        new = [n for n in os.listdir(base) if n not in known and n.startswith(f"docloom-{name}-")]
        inside = [len(os.listdir(f"{base}/{new[0]}/{n}")) for n in os.listdir(f"{base}/{new[0]}")]
        assert len(new) == 1 and 0 < max(inside) <= 1000
