"""Bucketed tables, prefix-filtered pairs and edges kept by a stream."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from docloom.operators import graph
from docloom.sources import buckets
from docloom.streaming import feeds


def _pairs(sets, least):
    """By brute force: (a, b, n, names)."""
    return sorted((a, b, len(sets[a] & sets[b]), tuple(sorted(sets[a] & sets[b]))) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= least)


def _rows(df):
    return sorted((r.a, r.b, r.n, tuple(r.names)) for r in df.collect())


def _sets(seed, documents=60, items=40):
    """Random item sets in which one item is in all documents and one in half of them."""
    rng = random.Random(seed)
    return {d: {"every", *(["half"] if d % 2 else []), *(f"i{int(rng.paretovariate(0.6)) % items}" for _ in range(rng.randrange(6)))} for d in range(documents)}


@pytest.mark.parametrize("least", [1, 2, 3])
def test_shared_equals_brute_force(spark, least):
    sets = _sets(least)
    rows = spark.createDataFrame([(d, x) for d, s in sets.items() for x in s] + [(None, "every"), (3, None), (5, "every")], "document_id long, item string")
    assert _rows(graph.shared(rows, "item", least, chunk=7)) == _pairs(sets, least)


def test_pairs_of_a_common_item_are_not_made(spark):
    sets = {d: {"every", f"own{d}", f"pair{d // 2}"} for d in range(200)}
    rows = spark.createDataFrame([(d, x) for d, s in sets.items() for x in s], "document_id long, item string")
    assert graph.candidates(rows, "item", 2).count() == 100
    assert _rows(graph.shared(rows, "item", 2)) == _pairs(sets, 2)


def test_shared_with_some_documents(spark):
    sets = _sets(9)
    rows = spark.createDataFrame([(d, x) for d, s in sets.items() for x in s], "document_id long, item string")
    wanted = rows.where("document_id % 10 = 4")
    want = sorted(r for a, b, n, names in _pairs(sets, 2) for r in ((a, b, n, names), (b, a, n, names)) if r[0] % 10 == 4)
    assert _rows(graph.shared_with(wanted, rows, 2)) == want


@pytest.mark.parametrize("least", [1, 2])
def test_shared_with_in_small_chunks(spark, least):
    sets = _sets(11)
    rows = spark.createDataFrame([(d, x) for d, s in sets.items() for x in s], "document_id long, item string")
    want = sorted(r for a, b, n, names in _pairs(sets, least) for r in ((a, b, n, names), (b, a, n, names)) if r[0] % 10 == 4)
    assert _rows(graph.shared_with(rows.where("document_id % 10 = 4"), rows, least, chunk=3)) == want
    single = {d: {f"t{d % 2}"} for d in range(50)}
    rows = spark.createDataFrame([(d, x) for d, s in single.items() for x in s], "document_id long, item string")
    want = sorted(r for a, b, n, names in _pairs(single, 1) for r in ((a, b, n, names), (b, a, n, names)) if r[0] % 10 == 4)
    assert _rows(graph.shared_with(rows.where("document_id % 10 = 4"), rows, 1, chunk=3)) == want


def test_pairs_of_one_item_are_many_tasks(spark):
    """Small inputs that make many pairs are not merged into a few tasks."""
    rows = spark.range(2000).select(F.col("id").alias("document_id"), F.lit("all").alias("item"))
    most = lambda df: max(df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first())
    assert most(graph.shared_with(rows.where("document_id % 10 = 0"), rows, 1, chunk=50)) < 200 * 2000 / 8
    assert most(graph.shared(rows, "item", 1, chunk=100)) < 2000 * 2000 / 2 / 8


def test_documents_are_sent_a_bounded_number_of_times(spark, monkeypatch):
    """What is sent grows with the documents of an item, not with their square."""
    monkeypatch.setattr(graph, "MOST_TASKS", 16)
    real, met = graph._cells, []
    monkeypatch.setattr(graph, "_cells", lambda a, b, *rest: met.extend([a, b]) or real(a, b, *rest))
    sent = lambda df: df.agg(F.sum(F.size([c for c in df.columns if c.startswith("docs")][0]) if "docs_0" in df.columns or "docs_1" in df.columns else F.lit(1))).first()[0]
    rows = spark.range(600).select(F.col("id").alias("document_id"), F.lit("all").alias("item"))
    assert graph.shared(rows, "item", 1, chunk=4).where("a < b").distinct().count() == 600 * 599 / 2
    assert sum(map(sent, met)) == 600 * 65
    met.clear()
    assert graph.shared_with(rows.where("document_id % 2 = 0"), rows, 1, chunk=2).where("a <> b").distinct().count() == 300 * 599
    assert sum(map(sent, met)) == 900 * 64


def test_a_version_holds_what_was_touched(spark, tmp_path):
    base = str(tmp_path / "t")
    rows = spark.range(100).select("id", F.lit("old").alias("v"))
    buckets.create(rows, base, ["id"], 16)
    change = spark.createDataFrame([(7, "new")], "id long, v string")
    which = buckets.touched(change, ["id"], 16)
    stored = buckets.load(spark, base, which)
    assert 0 < stored.count() < 100
    buckets.save(stored.where("id <> 7").unionByName(change), base, 1, which, ["id"], 16)
    assert len([p for p in (tmp_path / "t/data/v=1").iterdir() if p.name.startswith("bucket=")]) == 1
    assert {r.id: r.v for r in buckets.load(spark, base).collect()} == {i: "new" if i == 7 else "old" for i in range(100)}
    assert buckets.load(spark, base, upto=0).where("v = 'new'").count() == 0
    # a finished version is not written again, an emptied bucket is empty
    buckets.save(change, base, 1, which, ["id"], 16)
    assert buckets.load(spark, base).count() == 100
    buckets.save(stored.limit(0), base, 2, which, ["id"], 16)
    assert buckets.load(spark, base, which).count() == 0
    assert buckets.load(spark, base).count() == 100 - stored.count()


def test_an_unfinished_version_is_overwritten_and_old_ones_expire(spark, tmp_path):
    base = str(tmp_path / "t")
    rows = spark.range(40).withColumn("v", F.lit(0))
    buckets.create(rows, base, ["id"], 4)
    spark.range(1000, 1010).withColumn("v", F.lit(9)).withColumn("bucket", F.lit(2)).write.partitionBy("bucket").parquet(f"{base}/data/v=1")
    assert buckets.load(spark, base).count() == 40
    for n in range(1, 5):
        buckets.save(rows.withColumn("v", F.lit(n)), base, n, [0, 1, 2, 3], ["id"], 4)
        buckets.expire(spark, base, 2)
    assert {r.v for r in buckets.load(spark, base).collect()} == {4}
    assert {r.v for r in buckets.load(spark, base, upto=3).collect()} == {3}
    assert sorted(p.name for p in (tmp_path / "t/data").iterdir()) == ["v=3", "v=4"]


def _stream(spark, folder):
    return spark.readStream.schema("document_id long, names array<string>, k int, status string").option("maxFilesPerTrigger", 1).parquet(folder)


def _build(rows):
    return rows.select("document_id", F.explode("names").alias("item"))


def test_streamed_edges_equal_the_batch_result(spark, tmp_path, monkeypatch):
    """Inserts, changes, deletes and unchanged repeats over several batches, with a batch
    that is lost after two of its three tables."""
    rng = random.Random(3)
    folder, base, mark = str(tmp_path / "in"), str(tmp_path / "e"), str(tmp_path / "m")
    feeds.edge_tables(spark, base, size=4)
    sets: dict[int, set] = {}
    for k in range(4):
        sent = []
        for d in rng.sample(range(40), 18):
            if d in sets and rng.random() < 0.3:
                sets.pop(d)
                sent.append((d, [], k, "deleted"))
                continue
            if d not in sets or rng.random() < 0.7:
                sets[d] = _sets(k * 100 + d, 1)[0] | {f"x{d % 5}", f"y{rng.randrange(4)}"}
            sent.append((d, sorted(sets[d]), k, "completed"))
        spark.createDataFrame(sent, "document_id long, names array<string>, k int, status string").coalesce(1).write.mode("append").parquet(folder)
        run = lambda: feeds.shared_edge_stream(_stream(spark, folder), base, mark, _build, "k", 2, 4).awaitTermination()
        if k == 2:
            real = buckets.save

            def failing(rows, path, *args, **more):
                if path.endswith("/edges"):
                    raise RuntimeError("lost")
                real(rows, path, *args, **more)

            monkeypatch.setattr(buckets, "save", failing)
            with pytest.raises(Exception, match="lost"):
                run()
            monkeypatch.setattr(buckets, "save", real)
        run()
        assert _rows(feeds.shared_edges(spark, base)) == _pairs(sets, 2)


def test_an_index_shuffles_no_text_to_find_what_is_replaced(spark, tmp_path, monkeypatch):
    """Documents that come, come twice in a batch, come again and go, against a dict; a batch
    of new documents is neither ranked nor held against the stored texts."""
    folder, base, mark = (str(tmp_path / n) for n in ("in", "t", "m"))
    schema = "document_id long, k long, text string, status string"
    build = lambda rows: rows.select("document_id", F.col("text").alias("content"))
    buckets.create(build(spark.createDataFrame([], schema)), base, feeds.DOCUMENT, 4)
    plans, real = [], buckets.save
    monkeypatch.setattr(buckets, "save", lambda rows, *args: (plans.append(rows._jdf.queryExecution().optimizedPlan().toString()), real(rows, *args)))
    batches = [[(d, 0, f"a{d}", "completed") for d in range(20)], [(d, 1, f"b{d}", "completed") for d in range(20, 40)]]
    batches.append([(3, 2, "c", "completed"), (3, 3, "d", "completed"), (4, 2, "e", "completed"), (4, 3, None, "deleted"), (50, 2, "f", "completed"), (7, 2, None, "deleted")])
    want = {}
    for sent in batches:
        spark.createDataFrame(sent, schema).coalesce(1).write.mode("append").parquet(folder)
        for d, _, text, status in sent:
            want[d] = text if status == "completed" else None
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        feeds.index_stream(stream, base, mark, build, "k", 4).awaitTermination()
        assert sorted((r.document_id, r.content) for r in buckets.load(spark, base).collect()) == sorted((d, t) for d, t in want.items() if t)
    assert ["Join" in p or "Window" in p for p in plans] == [False, False, True]


def test_a_batch_of_a_landed_stream_is_one_slice(spark):
    from docloom.plans import stream_queries

    for parts in (1, 2, 3, 4):
        rows = spark.range(40, numPartitions=parts).select("id", (F.col("id") % 2 * 2).alias("k"))
        rows = rows.unionByName(spark.range(1).select(F.lit(99).cast("long").alias("id"), F.lit(1).cast("long").alias("k")))
        seen = []
        stream = stream_queries._stream(rows, "slices", F.col("k"), 3)
        stream.writeStream.foreachBatch(lambda b, n: seen.append({r.k for r in b.collect()})).trigger(availableNow=True).start().awaitTermination()  # noqa: B023
        assert seen == [{0}, {1}, {2}]


def test_a_question_counts_again_in_a_later_burst(spark):
    from docloom.plans import stream_queries

    rows = spark.createDataFrame([(i, "user", "What now?" if i < 6 else f"q {i}") for i in range(9)], "conv_id long, role string, text string")
    got = {r.burst: r.questions for r in stream_queries.stream_queries(lambda name: rows).collect()}
    assert got == {0: 2, 1: 2, 2: 2}
