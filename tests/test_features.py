"""Retries with timers, chunks from SQL, alerts by span, rolled-up sketches, hops, metadata."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from docloom.functions import tables
from docloom.operators import changes, chunking, graph, metrics
from docloom.streaming import retries

START = datetime.datetime(2024, 1, 1)
OUTCOME = "document_id string, status string, at timestamp"


def _outcomes(seed, documents=12, events=150):
    rng, at, out = random.Random(seed), 0, []
    for _ in range(events):
        at += rng.randrange(5, 90)
        out.append((f"d{rng.randrange(documents)}", rng.choice(["failed", "failed", "failed", "completed"]), START + datetime.timedelta(seconds=at)))
    return out


def _expected(rows, base=60, most=3):
    out, state = [], {}
    for d, status, at in [*sorted(rows, key=lambda r: r[2]), *((d, "end", datetime.datetime.max) for d in sorted({r[0] for r in rows}))]:
        failures, due = state.get(d, (0, None))
        if due and due <= at:
            out.append((d, "retry", failures, due))
            due = None
        if status == "completed":
            failures, due = 0, None
        elif status == "failed" and due is None:
            if failures < most:
                failures, due = failures + 1, at + datetime.timedelta(seconds=base * 2**failures)
            else:
                out.append((d, "given_up", failures, at))
                failures = 0
        state[d] = (failures, due)
    return sorted(out)


def _told(df):
    return sorted((r.document_id, r.kind, r.attempt, r["at"]) for r in df.where("document_id <> 'clock'").collect())


def test_retries_of_a_table(spark):
    rows = _outcomes(1)
    assert _told(retries.retries(spark.createDataFrame([*rows, (None, "failed", START), ("d1", "other", START), ("d1", "failed", None)], OUTCOME))) == _expected(rows)


def test_retry_stream_survives_a_lost_batch(spark, tmp_path):
    """Timers fire with the clock of the events; a batch that dies is run again."""
    retries.use_timers(spark)
    rows = _outcomes(2)
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    last = rows[-1][2]

    def send(part):
        spark.createDataFrame(part, OUTCOME).coalesce(1).write.mode("append").parquet(folder)

    def run(fail=None):
        stream = spark.readStream.schema(OUTCOME).option("maxFilesPerTrigger", 1).parquet(folder)
        found = retries.retry_stream(stream, late="1 second")

        def write(batch, number):
            if fail is not None and batch.count() >= fail:
                raise RuntimeError("lost")
            batch.write.mode("overwrite").parquet(f"{out}/b={number}")

        found.writeStream.foreachBatch(write).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()

    send(rows[:60])
    run()
    send(rows[60:110])
    with pytest.raises(Exception, match="lost"):
        run(fail=1)
    run()
    send(rows[110:])
    run()
    for days in (1, 2):
        send([("clock", "completed", last + datetime.timedelta(days=days))])
        run()
    assert _told(spark.read.schema("document_id string, kind string, attempt long, at timestamp").parquet(out)) == _expected(rows)


def test_retries_that_are_due_before_the_watermark(spark, tmp_path):
    """A batch's outcomes may be older than what the batch before has moved the watermark
    to; state goes with the rows of a task, not in calls for each document."""
    retries.use_timers(spark)
    at = lambda s: START + datetime.timedelta(seconds=s)
    sent = [[("d1", "failed", at(10))], [("d3", "failed", at(90)), ("clock", "completed", at(10_000))], [("d2", "failed", at(500)), ("d1", "failed", at(600)), ("d1", "completed", at(20_000))], [("clock", "completed", at(90_000))]]
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for part in sent:
        spark.createDataFrame(part, OUTCOME).coalesce(1).write.mode("append").parquet(folder)
    found = retries.retry_stream(spark.readStream.schema(OUTCOME).option("maxFilesPerTrigger", 1).parquet(folder), late="1 second")
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    assert _told(spark.read.schema(found.schema).parquet(out)) == _expected([r for part in sent for r in part if r[0] != "clock"])
    assert "TransformWithState" not in found._jdf.queryExecution().toString()


def test_retries_beyond_nanoseconds(spark, tmp_path):
    """Times after 2262 have no nanoseconds in pandas; fractions of a second stay."""
    retries.use_timers(spark)
    rows = [(d, status, at.replace(year=at.year + years) + datetime.timedelta(milliseconds=7)) for years in (0, 300, 3000) for d, status, at in _outcomes(4, 5, 30)]
    clock = [("clock", "completed", rows[-1][2] + datetime.timedelta(days=days)) for days in (1, 2)]
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for part in (rows[:30], rows[30:60], rows[60:], clock[:1], clock[1:]):
        spark.createDataFrame(part, OUTCOME).coalesce(1).write.mode("append").parquet(folder)
    found = retries.retry_stream(spark.readStream.schema(OUTCOME).option("maxFilesPerTrigger", 1).parquet(folder), late="1 second")
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    assert _told(spark.read.schema(found.schema).parquet(out)) == _expected(rows) == _told(retries.retries(spark.createDataFrame(rows, OUTCOME)))


def test_chunk_table_function(spark):
    rng = random.Random(3)
    texts = ["\n\n".join("| a | b |" if rng.random() < 0.1 else " ".join(rng.choice(["word", "x1", "né", "(a)", "\t"]) for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(12))) for _ in range(40)]
    texts += ["", None, "\n\n\n", "one line\nand another", " padded \n\n\ttab\n\n| t |", "y" * 5000]
    docs = spark.createDataFrame([(i, t, [None, "", "in short"][i % 3]) for i, t in enumerate(texts)], "document_id long, text string, summary string")
    tables.register(spark)
    columns = ["document_id", "sequence_number", "content", "chunk_type", "token_count"]
    for most, overlap in ((600, 60), (50, 10), (20, 0)):
        got = spark.sql(f"select d.document_id, c.* from {{docs}} d, lateral chunk(d.text, d.summary, most => {most}, overlap => {overlap}) c", docs=docs).select(*columns)
        want = chunking.chunk_documents(docs, most, overlap).select(*columns)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert spark.sql("select * from chunk('a')").count() == 1
    for wrong in ("chunk(1)", "chunk('a', most => -1)", "chunk('a', most => 'b')", "chunk('a', 2)"):
        with pytest.raises(Exception, match="chunk|CHUNK|udtf|UDTF"):
            spark.sql(f"select * from {wrong}").collect()


def test_alerts_by_span(spark):
    """Many points in a short time are no alert, two far apart are; holes end one."""
    minutes = {"many": [(i / 10, True) for i in range(40)], "few": [(0, True), (4, True), (8, True)], "hole": [(0, True), (4, True), (20, True)], "broken": [(0, True), (3, True), (4, False), (5, True), (9, True)], "null": [(0, True), (2, None), (5, True)]}
    rows = [(k, START + datetime.timedelta(minutes=m), v) for k, points in minutes.items() for m, v in points]
    points = spark.createDataFrame(rows, "key string, seen_at timestamp, ok boolean")
    got = {(r.key, r["first"].minute, r["last"].minute, r.fired_at.minute, r.n) for r in metrics.held_for(points, "key", "seen_at", F.col("ok"), "5 minutes", "6 minutes").collect()}
    assert got == {("few", 0, 8, 8, 3)}
    assert metrics.held_for(points, "key", "seen_at", F.col("ok"), "4 minutes", "6 minutes").count() == 3
    assert {r.key for r in metrics.held_alerts(points, "key", "seen_at", F.col("ok"), 5).collect()} == {"many"}
    even = spark.createDataFrame([("a", START + datetime.timedelta(minutes=m), m not in (3, 4, 9)) for m in range(16)], "key string, seen_at timestamp, ok boolean")
    both = [sorted((r["first"], r["last"], r.n) for r in f(even, "key", "seen_at", F.col("ok"), "3 minutes", "90 seconds").collect()) for f in (metrics.held_for, metrics.held_sessions)]
    assert both[0] == both[1] and len(both[0]) == 2


def test_rolled_up_sketches(spark):
    rows = spark.range(50_000).select((F.lit("2024-01-01").cast("timestamp") + F.make_interval(secs=(F.col("id") % 7200).cast("int"))).cast("timestamp").alias("seen_at"), F.pmod(F.xxhash64("id"), F.lit(100_000)).cast("double").alias("latency"))
    parts = metrics.latency_sketch(rows)
    assert parts.count() == 24
    hours = metrics.rolled_up(parts, "1 hour")
    (day,) = metrics.sketched_quantiles(metrics.rolled_up(hours, "1 day"), {"p50": 0.5, "p95": 0.95}).collect()
    assert day.n == 50_000
    for got, p in ((day.p50, 0.5), (day.p95, 0.95)):
        assert abs(rows.where(F.col("latency") <= got).count() / 50_000 - p) <= metrics.RANK_ERROR


def test_hops(spark):
    """Three hops and an early end; hidden documents are no steps; plans do not grow."""
    edges = spark.createDataFrame([(i, i + 1, "CITES", None, None) for i in range(1, 9)] + [(1, 5, "RELATED_TO", 0.5, None), (5, 1, "SUPERSEDES", None, None)], "src long, dst long, type string, strength double, count long")
    seeds = spark.createDataFrame([(1, 7, 1), (1, 7, 1), (2, 8, 9), (3, None, 2), (4, 7, None)], "query_id long, user_id long, document_id long")
    may = spark.createDataFrame([(7, d) for d in (1, 2, 3, 4, 5, 6)] + [(8, d) for d in (8, 6)], "user_id long, document_id long")
    hop = lambda **more: {(r.query_id, r.document_id, r.hop) for r in graph.expand_hops(seeds, edges, **more).collect()}
    assert hop(access=may, hops=3) == {(1, 2, 1), (1, 5, 1), (1, 3, 2), (1, 4, 2), (1, 6, 2), (2, 8, 1)}
    assert (1, 8, 4) in hop(hops=20, enforce_acl=False) and (1, 9, 5) in hop(hops=20, enforce_acl=False)
    step = graph.hop_step(seeds, seeds, edges.select("src", "dst"), may)
    deep = graph.expand_hops(seeds, edges, may, hops=6)
    assert deep._jdf.queryExecution().analyzed().toString().count("Relation") == 1
    assert step.columns == ["query_id", "user_id", "document_id"]


def test_metadata_and_notifications(spark):
    docs = spark.createDataFrame([(1, 1, 500), (1, 2, 50), (1, 3, 500)], "drive_id long, item_id long, n_chars long")
    feed = spark.createDataFrame([(1, 1, "me", "/drives/1/root:/HR"), (1, 2, "you", None)], "drive_id long, item_id long, created_by string, parent_path string")
    derived = spark.createDataFrame([(1, 1, "sales", "guide", ["a"], None), (1, 2, "sales", "guide", ["a"], "de"), (1, 3, "sales", "guide", None, "de")], "drive_id long, item_id long, department string, content_type string, topics array<string>, language string")
    got = {r.item_id: (r.created_by, r.page_count, r.department, r.content_type, r.topics, r.language) for r in changes.merge_metadata(docs, feed, None, derived).collect()}
    assert got == {1: ("me", 0, "hr", "guide", ["a"], "en"), 2: ("you", 0, None, None, None, "en"), 3: (None, 0, "sales", "guide", None, "de")}
    sent = spark.createDataFrame([("drives/d1/root", "s:d1:x"), ("drives/d2", "s:d2:y"), ("sites/d3", "s:d3:x"), ("drives", "s:d4:x"), ("drives/d5/root", "s"), (None, None)], "resource string, client_state string")
    assert [r.drive_id for r in changes.notifications(sent, "x").collect()] == ["d1"]
    assert sorted(r.drive_id for r in changes.notifications(sent).collect()) == ["d1", "d2", "d5"]
    gate = lambda kb: spark.createDataFrame([(kb, 1, 1, "completed", "h")], "kb string, drive_id long, item_id long, status string, content_hash string")
    assert changes.unchanged_gate(gate("a"), gate("b")).count() == 1 and changes.unchanged_gate(gate("a"), gate("a")).count() == 0
