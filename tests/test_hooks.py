"""Hooks, sinks and the streams that no query shows."""

from pyspark.sql import functions as F

from docloom.functions import hooks
from docloom.operators import access, chunking, metrics
from docloom.sources import buckets, files
from docloom.streaming import feeds


def test_embed_keeps_order_and_batches(spark):
    rows = spark.createDataFrame([(i, "x" * i if i else None) for i in range(40)], "id long, text string")
    out = hooks.embed(rows, lambda ts: [[float(len(t)), float(len(ts))] for t in ts]).collect()
    assert all(r.embedding[0] == len(r.text or "") and r.embedding[1] <= hooks.BATCH for r in out) and len(out) == 40


def test_fill_gaps(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", "given")], "id long, text string, department string")
    out = {r.id: r.department for r in hooks.fill_gaps(rows, lambda ts: [{"department": t.upper()} for t in ts], ["department"]).collect()}
    assert out == {1: "A", 2: "given"}


def test_default_vector_and_overlap(spark):
    r = spark.range(1).select(hooks.hashed_vector(F.lit("b a, b"), 8).alias("v"), hooks.lexical_overlap(F.lit("a b"), F.lit("b c")).alias("o"), hooks.lexical_overlap(F.lit(""), F.lit("b")).alias("z")).first()
    assert sum(r.v) == 3 and r.o == 0.5 and r.z == 0


def test_chunk_sink_and_clear(spark, tmp_path):
    chunks = spark.createDataFrame([(1, 10), (2, 11)], "chunk_id long, document_id long")
    docs = spark.createDataFrame([(10, "T", "hr", "main"), (11, "U", None, "care")], "document_id long, title string, department string, kb string")
    files.write_chunks(chunks, docs, str(tmp_path / "c"))
    files.write_chunks(chunks.limit(1), docs, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).where("kb = 'main'").count() >= 1
    assert spark.read.parquet(str(tmp_path / "c")).count() == 3
    files.write_snapshot(chunks, str(tmp_path / "s"), 0)
    assert spark.read.parquet(files.clear(spark, str(tmp_path / "s"), 1)).count() == 0


def test_access_stream_equals_batch(spark, tmp_path):
    old = spark.createDataFrame([(1, 5), (2, 6)], "document_id long, user_id long")
    grants = spark.createDataFrame([(1, "user", 7), (1, "group", 3)], "document_id long, principal_type string, principal_id long")
    closure = spark.createDataFrame([(3, 8), (3, 9)], "ancestor long, member long")
    buckets.create(old, str(tmp_path / "a"), feeds.DOCUMENT, 4)
    grants.coalesce(1).write.parquet(str(tmp_path / "g"))
    stream = spark.readStream.schema(grants.schema).parquet(str(tmp_path / "g"))
    feeds.access_stream(stream, closure, str(tmp_path / "a"), str(tmp_path / "m"), 4).awaitTermination()
    got = {tuple(r) for r in buckets.load(spark, str(tmp_path / "a")).select("document_id", "user_id").collect()}
    assert got == {tuple(r) for r in access.rebuild_access(old, grants, access.access_pairs(grants, closure)).select("document_id", "user_id").collect()} == {(2, 6), (1, 7), (1, 8), (1, 9)}


def test_late_items_are_dropped(spark):
    stored = spark.sql("select 1L as drive_id, 1L as item_id, timestamp '2024-01-02' as modified_at")
    batch = spark.sql("select 1L as drive_id, 1L as item_id, timestamp '2024-01-01' as modified_at union all select 1L, 2L, timestamp '2024-01-01'")
    assert [r.item_id for r in feeds.newer_only(batch, stored).collect()] == [2]


def test_sketch_quantiles(spark):
    rows = spark.range(1000).select(F.lit("2024-01-01").cast("timestamp").alias("seen_at"), F.col("id").cast("double").alias("latency"))
    r = metrics.latency_sketch(rows).select(F.kll_sketch_get_quantile_double("sketch", F.lit(0.5)).alias("q")).first()
    assert abs(r.q - 500) < 30


def test_sections_and_sheet_parts(spark):
    df = spark.sql("select 1L as document_id, array(named_struct('heading','A','level',1,'content','a b'), named_struct('heading','B','level',1,'content','c'), named_struct('heading','C','level',2,'content','d')) as sections")
    rows = chunking.merge_small_sections(df).orderBy("sequence_number").collect()
    assert [(r.heading, r.content) for r in rows] == [("A", "a b\n\nB\nc"), ("C", "d")]
    sheets = spark.createDataFrame([(1, "s", ["h1", "h2"], [["h1", "h2"], *[[str(i), "x"] for i in range(12)]])], "document_id long, name string, headers array<string>, rows array<array<string>>")
    parts = chunking.sheet_parts(sheets, 15, 5).orderBy("part").collect()
    assert parts[0].heading == "s (part 1)" and parts[0].content.splitlines()[:2] == ["| h1 | h2 |", "| --- | --- |"]
    assert sum(p.content.count("| x |") for p in parts) == 12
