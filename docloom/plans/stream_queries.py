"""Streams run to the end of their input; each must equal its batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import access, changes, metrics
from docloom.plans.change_queries import CLASS, applied
from docloom.plans.registry import query
from docloom.sources import buckets
from docloom.sources.scratch import scratch_path
from docloom.streaming import feeds, retries

#: Buckets of the tables kept here, which are small.
BUCKETS = 8
#: Least files that each slice of an input is written to, and rows of one; a micro-batch
#: reads one slice.
FILES, FILE_ROWS = 2, 500_000


def _landed(spark: SparkSession, path: str) -> int:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    return sum(f.getPath().getName().startswith("part-") for f in found)


def _stream(rows: DataFrame, name: str, slice_of: Column, slices: int) -> DataFrame:
    """``rows`` landed one slice after the other, read as a stream of as many batches.

    A part without rows makes no file, so empty ones fill up a slice to its number of files;
    a batch would else hold rows of two slices."""
    path = scratch_path(rows.sparkSession, name)
    files = max(FILES, -(-rows.count() // (slices * FILE_ROWS)))
    none = rows.sparkSession.createDataFrame([], rows.schema)
    for k in range(slices):
        rows.where(slice_of == k).repartition(files).write.mode("append").option("compression", "zstd").parquet(path)
        for _ in range(files * (k + 1) - _landed(rows.sparkSession, path)):
            none.write.mode("append").parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def _drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What an append stream has written once its input is used up."""
    spark = stream.sparkSession
    out, mark = scratch_path(spark, name), scratch_path(spark, name + "-mark")
    stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _step(k: int) -> str:
    """SQL of micro-batch k: late items go, the last of each document counts."""
    before = f"s{k}"
    late = "" if k == 0 else f"left join {before} o on o.drive_id = f.drive_id and o.item_id = f.item_id"
    keep = "" if k == 0 else "and (o.modified_at is null or f.modified_at >= o.modified_at)"
    last = f"l{k} as (select * from (select f.*, row_number() over (partition by f.drive_id, f.item_id order by f.modified_at desc, f.position desc) as rn from {{feed}} f {late} where cast(floor(f.position / 400) as bigint) % 3 = {k} {keep}) where rn = 1)"
    own = CLASS.replace("classified as", f"c{k} as").replace("lastf f", f"l{k} f").replace("{stored}", before)
    return f"{last}, {own}, s{k + 1} as ({applied(f'c{k}', before, k > 0)})"


@query("stream_snapshot", f"with s0 as (select drive_id, item_id, ctag, etag, status, retry_count from {{stored}}), {_step(0)}, {_step(1)}, {_step(2)} select * from s3")
def stream_snapshot(t):
    """The feed in three micro-batches; the snapshot after the last one."""
    stored = t("stored").select(*changes.KEY, "ctag", "etag", "status", "retry_count")
    spark = stored.sparkSession
    base = scratch_path(spark, "snapshots")
    feeds.snapshot_table(stored, t("feed"), base, BUCKETS)
    feeds.upsert_stream(_stream(t("feed"), "feed", F.expr("cast(floor(position / 400) as bigint) % 3"), 3), base, scratch_path(spark, "mark"), size=BUCKETS).awaitTermination()
    return buckets.load(spark, base)


@query(
    "stream_index",
    """with d as (select doc_id as document_id, doc_id % 3 as k, text from {documents} union all select doc_id, 2, 'again ' || doc_id from {documents} where doc_id % 6 = 0)
      select document_id, text as content from d where not (k = 0 and document_id % 6 = 0) and not (document_id % 9 = 4)""",
)
def stream_index(t):
    """Chunks kept in step with documents that come, come again and are deleted."""
    docs = t("documents").select(F.col("doc_id").alias("document_id"), (F.col("doc_id") % 3).alias("k"), "text", F.lit("completed").alias("status"))
    again = docs.where("document_id % 6 = 0").withColumns({"k": F.lit(2).cast("long"), "text": F.concat(F.lit("again "), F.col("document_id").cast("string"))})
    # that a document is gone is said without its text
    gone = docs.where("document_id % 9 = 4").withColumns({"k": F.lit(3).cast("long"), "text": F.lit(None).cast("string"), "status": F.lit("deleted")})
    spark = docs.sparkSession
    base = scratch_path(spark, "chunks")
    build = lambda rows: rows.select("document_id", F.col("text").alias("content"))
    buckets.create(build(docs.limit(0)), base, feeds.DOCUMENT, BUCKETS)
    feeds.index_stream(_stream(docs.unionByName(again).unionByName(gone), "documents", F.col("k"), 4), base, scratch_path(spark, "mark"), build, "k", BUCKETS).awaitTermination()
    return buckets.load(spark, base)


@query(
    "stream_shares_entity",
    """with m as (select distinct document_id, entity_id, name from {mentions}),
      s as (select document_id, name from m where case when document_id % 7 = 3 then false when document_id % 5 = 1 then entity_id % 2 = 0 when document_id % 3 = 1 then entity_id % 4 <> 0 else true end)
      select x.document_id as a, y.document_id as b, count(*) as n, array_to_string(list_sort(list(distinct x.name)), ',') as names from s x join s y on x.name = y.name and x.document_id < y.document_id group by 1, 2 having count(*) >= 2""",
)
def stream_shares_entity(t):
    """Edges of shared entities after documents came, came again with more or other
    entities, and went, over four batches."""
    said = t("mentions").select("document_id", "entity_id", "name").distinct()
    rows = lambda k, which, what: said.where(which).groupBy("document_id").agg(F.collect_set(F.when(F.expr(what), F.col("name"))).alias("names")).withColumns({"k": F.lit(k), "status": F.lit("completed")})
    gone = said.where("document_id % 7 = 3").select("document_id").distinct().select("document_id", F.array().cast("array<string>").alias("names"), F.lit(3).alias("k"), F.lit("deleted").alias("status"))
    sent = [rows(0, "document_id % 3 <> 2", "entity_id % 4 <> 0"), rows(1, "document_id % 3 = 2", "true"), rows(1, "document_id % 3 = 0", "true"), rows(2, "document_id % 5 = 1", "entity_id % 2 = 0"), gone]
    docs = sent[0]
    for more in sent[1:]:
        docs = docs.unionByName(more)
    spark = docs.sparkSession
    base = scratch_path(spark, "edges")
    feeds.edge_tables(spark, base, size=BUCKETS)
    build = lambda rows: rows.select("document_id", F.explode("names").alias("item"))
    feeds.shared_edge_stream(_stream(docs, "said", F.col("k"), 4), base, scratch_path(spark, "mark"), build, "k", 2, BUCKETS).awaitTermination()
    return feeds.shared_edges(spark, base).withColumn("names", F.concat_ws(",", "names"))


# Bursts an hour apart; between them a lone row moves the watermark past the last burst, and
# another one's batch lets the state expire, which Spark does after a batch's own rows.

def _bursts(rows: DataFrame, number: Column) -> DataFrame:
    """``rows`` with ``seen_at`` in one of three bursts and their batch ``k``."""
    start = F.lit("2024-01-01").cast("timestamp")
    at = lambda hours, seconds: (start + F.make_interval(hours=hours, secs=seconds)).cast("timestamp")
    out = rows.withColumns({"burst": (number % 3).cast("int"), "seen_at": at((number % 3).cast("int"), (number % 240).cast("int"))}).withColumn("k", 3 * F.col("burst"))
    ticks = rows.sparkSession.range(6).select((F.col("id") % 3).cast("int").alias("burst"), F.floor(F.col("id") / 3).cast("int").alias("turn"))
    lone = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields]
    ticks = ticks.select(*lone, "burst", at(F.col("burst"), F.lit(2400)).alias("seen_at"), (3 * F.col("burst") + 1 + F.col("turn")).alias("k"))
    return out.unionByName(ticks)


@query("stream_notices", "select drive_id, burst, count(*) as n from (select distinct drive_id, cast(position % 3 as integer) as burst from {feed}) group by all")
def stream_notices(t):
    """One notification per drive and burst: those within the watermark collapse."""
    rows = _bursts(t("feed").select("drive_id", "position"), F.col("position"))
    out = feeds.collapse_notifications(_stream(rows, "notices", F.col("k"), 9))
    return _drained(out.select("drive_id", "burst"), "notices").where("drive_id is not null").groupBy("drive_id", "burst").agg(F.count("*").alias("n"))


@query(
    "stream_rates",
    """with w as (select time_bucket(interval '1 minute', seen_at) - to_minutes(m) as start, count(*) as n from {metrics}, range(0, 5) r(m) group by 1)
      select start, n from w where start + interval '5 minutes' <= (select max(seen_at) - interval '10 minutes' from {metrics})""",
)
def stream_rates(t):
    """Sliding counts of the windows that the watermark has closed, over four batches."""
    rows = t("metrics")
    cuts = rows.select(F.percentile_approx(F.unix_micros("seen_at"), [0.25, 0.5, 0.75], 1000).alias("c")).first().c or []
    which = sum(((F.unix_micros("seen_at") > c).cast("int") for c in cuts), F.lit(0))
    out = _drained(feeds.metric_stream(_stream(rows.withColumn("k", which), "metrics", F.col("k"), 4).drop("k")), "rates")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("stream_queries", "select cast(conv_id % 3 as integer) as burst, count(distinct sha256(lower(text) || ':')) as questions from {conversations} where role = 'user' group by 1")
def stream_queries(t):
    """Questions of each burst without those that repeat within two minutes."""
    rows = t("conversations").where("role = 'user'").select("text", F.lit(None).cast("string").alias("department"), "conv_id")
    rows = _bursts(rows, F.col("conv_id")).withColumn("seen_at", F.when(F.col("text").isNull(), F.col("seen_at")).otherwise(F.date_trunc("hour", "seen_at")))
    out = feeds.dedup_queries(_stream(rows, "questions", F.col("k"), 9)).where("text is not null")
    return _drained(out.select("key", "burst"), "questions").groupBy("burst").agg(F.count("*").alias("questions"))


@query(
    "stream_retries",
    """with e as (select cast(user_id as varchar) as document_id, event_id, event_type = 'error' as failed, timestamp '2024-01-01 00:00:00' + to_seconds(event_id * 300) as seen from {events} where event_type in ('error', 'purchase')),
      s as (select *, sum(case when failed then 0 else 1 end) over (partition by document_id order by event_id rows unbounded preceding) as part from e),
      f as (select *, (row_number() over (partition by document_id, part order by event_id) - 1) % 4 as k from s where failed)
      select document_id, case when k = 3 then 'given_up' else 'retry' end as kind, least(k + 1, 3) as attempt, seen + to_seconds(case k when 0 then 60 when 1 then 120 when 2 then 240 else 0 end) as \"at\" from f""",
)
def stream_retries(t):
    """Retries that fall due as the clock of the events goes on, over five batches."""
    at = (F.lit("2024-01-01").cast("timestamp") + F.make_interval(secs=F.col("event_id") * 300)).cast("timestamp")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed")
    rows = t("events").select(F.col("user_id").cast("string").alias("document_id"), status.alias("status"), at.alias("at"), "event_id").where("status is not null")
    cuts = rows.select(F.percentile_approx("event_id", [0.25, 0.5, 0.75], 1000).alias("c")).first().c or []
    rows = rows.withColumn("k", sum(((F.col("event_id") > c).cast("int") for c in cuts), F.lit(0))).drop("event_id")
    # a last outcome of another document moves the clock past all that waits
    last = rows.agg((F.max("at") + F.expr("interval 1 day")).alias("at")).select(F.lit("clock").alias("document_id"), F.lit("completed").alias("status"), "at", F.lit(4).alias("k"))
    retries.use_timers(rows.sparkSession)
    out = _drained(retries.retry_stream(_stream(rows.unionByName(last), "outcomes", F.col("k"), 5)), "retries")
    return out.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query(
    "stream_alerts",
    """with m as (select department, time_bucket(interval '1 hour', seen_at) as seen, avg(latency) as v from {metrics} group by 1, 2), p as (select department, seen from m where v > 45),
      g as (select *, seen - to_hours(row_number() over (partition by department order by seen)) as island from p)
      select department, min(seen) as first, max(seen) as last, count(*) as n from g group by department, island having max(seen) - min(seen) >= interval '2 hours'""",
)
def stream_alerts(t):
    """Hourly means that stay high for two hours, as session windows of a stream."""
    points = t("metrics").groupBy("department", F.window("seen_at", "1 hour")["start"].alias("at")).agg(F.avg("latency").alias("v"))
    day = F.dayofmonth("at")
    rows = points.withColumn("k", F.floor((day - 1) / 8).cast("int"))
    clock = rows.groupBy("department").agg((F.max("at") + F.expr("interval 2 days")).alias("at")).select("department", "at", F.lit(100.0).alias("v"), F.lit(4).alias("k"))
    stream = _stream(rows.unionByName(clock), "points", F.col("k"), 5).withWatermark("at", "10 minutes")
    # one point that holds for no span moves the watermark past all others
    out = _drained(metrics.held_sessions(stream, "department", "at", F.col("v") > 45, "2 hours", "61 minutes"), "alerts")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first", "last")})


@query(
    "stream_access",
    """with recursive c as (select parent as ancestor, child as member from {group_edges} union select c.ancestor, e.child from c join {group_edges} e on e.parent = c.member),
      n as (select distinct document_id, user_id + 1000000 as user_id from {access} where document_id % 3 = 0 union select document_id, member from {access} a join c on c.ancestor = a.user_id where document_id % 3 = 1)
      select document_id, user_id from {access} where document_id % 3 = 2 union all select document_id, user_id from n""",
)
def stream_access(t):
    """Access pairs rebuilt for the documents whose grants arrive, over two batches."""
    pairs = t("access").select("document_id", "user_id")
    direct = pairs.where("document_id % 3 = 0").select("document_id", F.lit("user").alias("principal_type"), (F.col("user_id") + 1_000_000).alias("principal_id"), F.lit(0).alias("k"))
    groups = pairs.where("document_id % 3 = 1").select("document_id", F.lit("group").alias("principal_type"), F.col("user_id").alias("principal_id"), F.lit(1).alias("k"))
    spark = pairs.sparkSession
    base = scratch_path(spark, "access")
    buckets.create(pairs, base, feeds.DOCUMENT, BUCKETS)
    stream = _stream(direct.unionByName(groups), "grants", F.col("k"), 2)
    feeds.access_stream(stream, access.expand_groups(t("group_edges")), base, scratch_path(spark, "mark"), BUCKETS).awaitTermination()
    return buckets.load(spark, base)
