"""Structured Streaming forms of the change feed, notifications and metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.operators import access, changes, graph
from docloom.operators.metrics import sliding_rates
from docloom.sources import buckets
from docloom.sources.scratch import dropped, kept

DOCUMENT = ["document_id"]


def upsert_stream(feed: DataFrame, base: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None, size: int = buckets.BUCKETS, keep: int = 2) -> StreamingQuery:
    """Apply each micro-batch of feed items to the snapshot, as a batch run would.

    ``base`` is a bucketed table (``sources.buckets``) on the document key.  Batch n reads
    the buckets of its items as of version n and writes these buckets as version n + 1; the
    others stay, and what no version after n reads is deleted.  A replayed batch leaves a
    finished version and overwrites an unfinished one, so the result is the same.  Items
    older than what is stored of their document are late and dropped."""

    def run(batch: DataFrame, number: int) -> None:
        spark, key = batch.sparkSession, changes.key_of(batch)
        which = buckets.touched(batch, key, size)
        stored = buckets.load(spark, base, which, number)
        found = changes.classify(changes.last_per_key(newer_only(batch, stored)), stored)
        buckets.save(changes.apply(stored, found).select(*stored.columns), base, number + 1, which, key, size)
        if on_batch:
            on_batch(found, number)
        buckets.expire(spark, base, keep)

    return feed.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot_table(stored: DataFrame, feed: DataFrame, base: str, size: int = buckets.BUCKETS) -> None:
    """The bucketed table that ``upsert_stream`` keeps, with all columns that items set."""
    none = feed.sparkSession.createDataFrame([], feed.schema)
    buckets.create(changes.apply(stored, changes.classify(none, stored)), base, changes.key_of(stored, feed), size)


def last_versions(batch: DataFrame, order: str) -> DataFrame:
    """Of a document's rows in one batch the last by ``order``."""
    newest = Window.partitionBy(*DOCUMENT).orderBy(F.desc_nulls_last(order))
    return batch.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def _ranked_only(batch: DataFrame, order: str, repeated: DataFrame) -> DataFrame:
    """``last_versions`` where only the documents ``repeated`` have more than one row: the
    texts of the others are not shuffled for it."""
    if repeated.isEmpty():
        return batch
    ids = repeated.select(F.col("document_id").alias("_d"))
    same = F.col("document_id").eqNullSafe(F.col("_d"))
    return batch.join(ids, same, "left_anti").unionByName(last_versions(batch.join(ids, same, "left_semi"), order))


def index_stream(documents: DataFrame, base: str, checkpoint: str, build: Callable[[DataFrame], DataFrame], order: str, size: int = buckets.BUCKETS, keep: int = 2) -> StreamingQuery:
    """Keep a derived table (chunks, mentions) in step with a stream of documents.

    ``build`` makes a document's rows; the rows of every document of a batch are replaced,
    those with status deleted get none.  ``base`` is a bucketed table on document_id, of
    which a batch rewrites the buckets of its documents."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        ids = kept(batch.groupBy(*DOCUMENT).agg(F.count("*").alias("n")), "ids")
        repeated = kept(ids.where("n > 1").select(*DOCUMENT), "repeated")
        which = buckets.touched(ids, DOCUMENT, size)
        old = buckets.load(spark, base, which, number)
        # ids go first: stored texts are shuffled for it only if many of them are replaced
        replaced = kept(old.select(*DOCUMENT).distinct().join(ids, "document_id", "left_semi"), "replaced")
        stay = old if replaced.isEmpty() else changes.delete_documents(old, replaced)
        new = build(_ranked_only(batch, order, repeated).where("status <> 'deleted'"))
        buckets.save(stay.unionByName(new), base, number + 1, which, DOCUMENT, size)
        buckets.expire(spark, base, keep)
        for done in (ids, repeated, replaced):
            dropped(done)

    return documents.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def edge_tables(spark, base: str, id_type: str = "long", item_type: str = "string", size: int = buckets.BUCKETS) -> None:
    """Empty tables for ``shared_edge_stream``."""
    empty = lambda schema: spark.createDataFrame([], schema)
    items = f"document_id {id_type}, item {item_type}"
    buckets.create(empty(items), f"{base}/items", DOCUMENT, size)
    buckets.create(empty(items), f"{base}/postings", ["item"], size)
    buckets.create(empty(f"a {id_type}, b {id_type}, n long, names array<{item_type}>"), f"{base}/edges", ["a"], size)


def shared_edge_stream(documents: DataFrame, base: str, checkpoint: str, build: Callable[[DataFrame], DataFrame], order: str, least: int = 2, size: int = buckets.BUCKETS, keep: int = 2) -> StreamingQuery:
    """Keep the edges of documents with ``least`` common items in step with a stream.

    ``build`` makes (document_id, item) of documents.  Three bucketed tables are kept (see
    ``edge_tables``): items by document, the same rows by item, and edges by their first
    end, each edge both ways.  A batch holds its documents' items against the stored ones;
    only documents whose items differ are gone on with.  Their edges are retracted, both
    ways, and made anew by joining their items with the postings of those items.  Buckets
    of other items, and of documents that neither had nor get such an edge, are not read.

    Pairs below the threshold are not stored, since a common item would make them all, so a
    changed document's pairs are counted from its items, not from the difference."""

    def run(batch: DataFrame, number: int) -> None:
        spark, batch = batch.sparkSession, last_versions(batch, order)
        at = lambda name, which: buckets.load(spark, f"{base}/{name}", which, number)
        ids = kept(batch.select(*DOCUMENT).distinct(), "ids")
        new = kept(build(batch.where("status <> 'deleted'")).select("document_id", "item").where("item is not null").distinct(), "new")
        own = buckets.touched(ids, DOCUMENT, size)
        items = at("items", own)
        old = items.join(ids, "document_id", "left_semi")
        # items that came or went; documents without any are as they were
        delta = kept(new.withColumn("sign", F.lit(1)).unionByName(old.withColumn("sign", F.lit(-1))).groupBy("document_id", "item").agg(F.sum("sign").alias("sign")).where("sign <> 0"), "delta")
        changed = kept(delta.select(*DOCUMENT).distinct(), "changed")
        own = buckets.touched(changed, DOCUMENT, size)
        wanted = new.join(changed, "document_id", "left_semi")
        buckets.save(changes.delete_documents(at("items", own), changed).unionByName(wanted), f"{base}/items", number + 1, own, DOCUMENT, size)

        # postings: what came is added, what went is taken away
        which = buckets.touched(delta, ["item"], size)
        gone, came = (delta.where(F.col("sign") == s).select("document_id", "item") for s in (-1, 1))
        patch = lambda rows: rows.join(gone, ["document_id", "item"], "left_anti").unionByName(came.select(*rows.columns))
        buckets.save(patch(at("postings", which)), f"{base}/postings", number + 1, which, ["item"], size)

        # edges of changed documents, from the postings of their items
        read = buckets.touched(wanted, ["item"], size)
        postings = buckets.load(spark, f"{base}/postings", read, number + 1)
        made = kept(graph.shared_with(wanted, postings, least), "made")
        dropped_edges = at("edges", own).join(changed.withColumnRenamed("document_id", "a"), "a", "left_semi")
        back = lambda rows: rows.select(F.col("b").alias("a"), F.col("a").alias("b"), "n", "names")
        ends = changed.unionByName(dropped_edges.select(F.col("b").alias("document_id"))).unionByName(made.select(F.col("b").alias("document_id"))).distinct()
        which = buckets.touched(ends.withColumnRenamed("document_id", "a"), ["a"], size)
        left = graph.delete_from_graph(at("edges", which).withColumnsRenamed({"a": "src", "b": "dst"}), changed).withColumnsRenamed({"src": "a", "dst": "b"})
        # an edge between two changed documents is made from both of its ends
        both = made.unionByName(back(made)).dropDuplicates(["a", "b"])
        buckets.save(left.unionByName(both), f"{base}/edges", number + 1, which, ["a"], size)
        for name in ("items", "postings", "edges"):
            buckets.expire(spark, f"{base}/{name}", keep)
        for done in (ids, new, delta, changed, made):
            dropped(done)

    return documents.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def shared_edges(spark, base: str) -> DataFrame:
    """(a, b, n, names), a < b, of the edges kept by ``shared_edge_stream``."""
    return buckets.load(spark, f"{base}/edges").where("a < b")


def collapse_notifications(notices: DataFrame, within: str = "10 minutes") -> DataFrame:
    """One notification per drive while it is within the watermark."""
    return notices.withWatermark("seen_at", within).dropDuplicatesWithinWatermark(["drive_id"])


def dedup_queries(queries: DataFrame, within: str = "2 minutes") -> DataFrame:
    """Drop repeated questions of a department within two minutes.

    A question is forgotten at the end of the first batch whose watermark has passed that
    time, so a later repeat in that batch or an earlier one goes too."""
    key = F.sha2(F.concat_ws(":", F.lower("text"), F.coalesce("department", F.lit(""))), 256)
    return queries.withColumn("key", key).withWatermark("seen_at", within).dropDuplicatesWithinWatermark(["key"])


def metric_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Sliding counts, final once the watermark has passed the window."""
    return sliding_rates(events.withWatermark("seen_at", late))


def access_stream(grants: DataFrame, closure: DataFrame, base: str, checkpoint: str, size: int = buckets.BUCKETS, keep: int = 2) -> StreamingQuery:
    """Rebuild the access pairs of the documents whose grants arrive, in a bucketed table."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        which = buckets.touched(batch, DOCUMENT, size)
        new = access.access_pairs(batch, closure)
        buckets.save(access.rebuild_access(buckets.load(spark, base, which, number), batch, new), base, number + 1, which, DOCUMENT, size)
        buckets.expire(spark, base, keep)

    return grants.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newer_only(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Late items: what is older than the stored version of its key is dropped."""
    if "modified_at" not in stored.columns:
        return batch
    key = changes.key_of(batch, stored)
    old = stored.select(*key, F.col("modified_at").alias("_at"))
    return batch.join(old, key, "left").where(F.col("_at").isNull() | (F.col("modified_at") >= F.col("_at"))).drop("_at")
