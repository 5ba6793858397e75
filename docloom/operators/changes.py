"""Change feed against the stored documents: classify, apply, reconcile.

One join per batch replaces a lookup per item.  Of repeated items the last by
(modification time, feed position) counts; snapshots are rewritten, never updated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import department_from_path, file_extension, notification_drive, notification_verified

SUPPORTED = ["pptx", "docx", "pdf", "xlsx"]
KEY = ["drive_id", "item_id"]
#: What an item says of its document; ``SET_ONCE`` only counts when it is created.
ITEM = ["name", "size", "url", "modified_at", "modified_by"]
SET_ONCE = ["site_id", "mime_type", "parent_path", "created_by"]


def key_of(*tables: DataFrame) -> list[str]:
    """The key of documents: with the knowledge base, where all tables name it."""
    return [*(["kb"] if all("kb" in t.columns for t in tables) else []), *KEY]


def last_per_key(feed: DataFrame, key: list[str] | None = None) -> DataFrame:
    newest = Window.partitionBy(*(key or key_of(feed))).orderBy(F.desc("modified_at"), F.desc("position"))
    return feed.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def path_allowed(path: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Case-insensitive substring filter on a path."""
    low, out = F.lower(path), F.lit(True)
    if include:
        out &= F.exists(F.array(*[F.lit(x.lower()) for x in include]), lambda x: low.contains(x))
    if exclude:
        out &= ~F.exists(F.array(*[F.lit(x.lower()) for x in exclude]), lambda x: low.contains(x))
    return out


def classify(feed: DataFrame, stored: DataFrame, supported: list[str] = SUPPORTED, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """``feed`` with ``change``: DELETED, CREATED, UPDATED, PERMISSION_CHANGED or null.

    A stored row with status deleted counts as unknown.  The path filter holds back
    everything but deletes."""
    key = key_of(feed, stored)
    live = stored.where("status <> 'deleted'").select(*key, F.col("ctag").alias("old_ctag"), F.col("etag").alias("old_etag"), F.lit(True).alias("known"))
    rows = feed.join(live, key, "left")
    allowed = path_allowed(F.coalesce("parent_path", F.lit("")), include, exclude) if include or exclude else F.lit(True)
    known = F.coalesce("known", F.lit(False))
    other = lambda new, old: F.col(new).isNotNull() & (F.col(new) != "") & (F.coalesce(F.col(old), F.lit("")) != F.col(new))
    change = (
        F.when(F.col("is_deleted"), F.when(known, "DELETED"))
        .when(F.col("is_folder") | ~allowed | ~file_extension(F.col("name")).isin(supported), None)
        .when(~known, "CREATED")
        .when(other("ctag", "old_ctag"), "UPDATED")
        .when(other("etag", "old_etag"), "PERMISSION_CHANGED")
    )
    return rows.withColumn("change", change).drop("known", "old_ctag", "old_etag")


def limit_changes(changes: DataFrame, most: int, partition: list[str]) -> DataFrame:
    """The first ``most`` creates and updates of each partition; deletes always pass."""
    order = Window.partitionBy(*partition, F.col("change") == "DELETED").orderBy("position")
    return changes.where("change is not null").withColumn("dispatched", (F.col("change") == "DELETED") | (F.row_number().over(order) <= most))


def apply(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """The next snapshot: one full outer join of documents with their last change.

    Creates and updates take over what the item says (``ITEM`` and, for a new document,
    ``SET_ONCE``, as far as ``changes`` has those columns), clear the error and go back to
    pending; an update of an unknown document is a create; deletes leave a tombstone;
    permission changes set the etag and who made them.
    """
    key = key_of(stored, changes)
    said = [c for c in (*ITEM, *SET_ONCE) if c in changes.columns]
    rest = [c for c in stored.columns if c not in (*key, *said, "ctag", "etag", "status", "retry_count", "error_message")]
    new = last_per_key(changes.where("change is not null"), key).select(*key, "change", *[F.col(c).alias(f"n_{c}") for c in ("ctag", "etag", *said)])
    old = stored.withColumns({c: F.lit(None).cast(changes.schema[c].dataType) for c in said if c not in stored.columns})
    rows = old.join(new, key, "full_outer")
    write = F.col("change").isin("CREATED", "UPDATED")
    fresh = F.coalesce(F.col("change") == "CREATED", F.lit(False)) | F.col("status").isNull()

    def item(c: str):
        takes = write & fresh if c in SET_ONCE else write | (F.col("change") == "PERMISSION_CHANGED") if c == "modified_by" else write
        return F.when(takes, F.coalesce(f"n_{c}", c)).otherwise(F.col(c)).alias(c)

    out = [
        *key,
        F.when(write, F.coalesce("n_ctag", "ctag")).otherwise(F.col("ctag")).alias("ctag"),
        F.when(write | (F.col("change") == "PERMISSION_CHANGED"), F.coalesce("n_etag", "etag")).otherwise(F.col("etag")).alias("etag"),
        F.when(write, "pending").when(F.col("change") == "DELETED", "deleted").otherwise(F.col("status")).alias("status"),
        F.when(write, F.lit(0)).otherwise(F.col("retry_count")).cast("long").alias("retry_count"),
        *map(item, said),
    ]
    if "error_message" in stored.columns:
        out.append(F.when(~F.coalesce(write, F.lit(False)), F.col("error_message")).alias("error_message"))
    return rows.select(*out, *rest)


def cascade(gone: DataFrame, chunks: DataFrame, access: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, access pairs and edges without the deleted documents (document_id)."""
    from docloom.operators.graph import delete_from_graph

    return delete_documents(chunks, gone), delete_documents(access, gone), delete_from_graph(edges, gone)


def change_stats(changes: DataFrame) -> DataFrame:
    """Counts of each kind of change per drive, and what was skipped."""
    count = lambda kind: F.sum((F.coalesce("change", F.lit("")) == kind).cast("long"))
    return changes.groupBy("drive_id").agg(count("CREATED").alias("created"), count("UPDATED").alias("updated"), count("DELETED").alias("deleted"), count("PERMISSION_CHANGED").alias("permission_changed"), count("").alias("skipped"))


def orphans(stored: DataFrame, listing: DataFrame) -> DataFrame:
    """Live documents that the full listing does not hold."""
    key = key_of(stored, listing)
    return stored.where("status <> 'deleted'").join(listing.select(*key).distinct(), key, "left_anti")


def reconcile(stored: DataFrame, listing: DataFrame) -> DataFrame:
    """Deletes for orphans and classified changes of a full listing, in one table."""
    key = key_of(stored, listing)
    gone = orphans(stored, listing).select(*key, F.lit("DELETED").alias("change"))
    return gone.unionByName(classify(last_per_key(listing), stored).where("change is not null").select(*key, "change"))


def reconcile_totals(stored: DataFrame, listing: DataFrame) -> DataFrame:
    """Items listed, live documents and orphans of every drive that has any of them."""
    items = listing.groupBy("drive_id").agg(F.countDistinct("item_id").alias("items"))
    docs = stored.where("status <> 'deleted'").groupBy("drive_id").agg(F.count("*").alias("documents"))
    gone = orphans(stored, listing).groupBy("drive_id").agg(F.count("*").alias("orphans"))
    return items.join(docs, "drive_id", "full_outer").join(gone, "drive_id", "full_outer").fillna(0, ["items", "documents", "orphans"])


def unchanged_gate(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming rows whose content differs from the last completed version."""
    key = key_of(incoming, stored)
    done = stored.where("status = 'completed'").select(*key, F.col("content_hash").alias("_old"))
    return incoming.join(done, key, "left").where(F.col("_old").isNull() | (F.col("_old") != F.col("content_hash"))).drop("_old")


def notifications(rows: DataFrame, secret: str | None = None) -> DataFrame:
    """(drive_id, site_id, ...) of verified notifications (resource, client_state, ...) of
    drives; their other columns are kept."""
    known = rows.withColumns({"drive_id": notification_drive(F.col("resource")), "site_id": F.get(F.split("client_state", ":"), F.lit(0))})
    return known.where(F.col("drive_id").isNotNull() & notification_verified(F.col("client_state"), secret))


#: Columns of a document's metadata by where they come from.
FROM_FEED = ["created_by", "created_at", "modified_at", "modified_by", "url", "site_name", "library_name"]
FROM_FILE = ["page_count", "word_count", "title"]
DERIVED = ["content_type", "topics", "language"]


def merge_metadata(documents: DataFrame, feed: DataFrame | None = None, files: DataFrame | None = None, derived: DataFrame | None = None, key: list[str] = KEY) -> DataFrame:
    """Metadata of documents (key, text length ``n_chars``): who, when and where from the
    feed, counts and title from the file, and content type, topics and language from what
    was derived of the text, which counts only for texts of more than 100 characters.  The
    department is that of the feed's path, else the derived one; the language else "en"."""
    out = documents
    for name, table, columns in (("feed", feed, [*FROM_FEED, "parent_path"]), ("file", files, FROM_FILE), ("derived", derived, [*DERIVED, "department"])):
        if table is not None:
            have = [c for c in columns if c in table.columns]
            own = table.select(*key, F.struct(*have).alias(f"_{name}"))
            out = out.join(own, key, "left")
        else:
            out = out.withColumn(f"_{name}", F.lit(None))
    said = F.col("n_chars") > 100
    field = lambda name, table, c: F.col(f"_{name}.{c}") if table is not None and c in table.columns else F.lit(None)
    columns = [field("feed", feed, c).alias(c) for c in FROM_FEED]
    columns += [F.coalesce(field("file", files, c), F.lit(0)).alias(c) if c != "title" else field("file", files, c).alias(c) for c in FROM_FILE]
    columns += [F.when(said, field("derived", derived, c)).alias(c) for c in DERIVED[:-1]]
    columns.append(F.coalesce(F.when(said, field("derived", derived, "language")), F.lit("en")).alias("language"))
    path = department_from_path(field("feed", feed, "parent_path").cast("string"))
    columns.append(F.coalesce(path, F.when(said, field("derived", derived, "department"))).alias("department"))
    return out.select(*key, *columns)


def retry_selection(stored: DataFrame, most: int = 3) -> DataFrame:
    """Failed documents with retries left, back to pending."""
    return stored.where((F.col("status") == "failed") & (F.col("retry_count") < most)).withColumn("status", F.lit("pending"))


def failure_record(failed: DataFrame) -> DataFrame:
    """Status failed, the error cut to 1000 characters, one more retry."""
    return failed.withColumns({"status": F.lit("failed"), "error_message": F.substring("error", 1, 1000), "retry_count": F.col("retry_count") + 1}).drop("error")


def next_attempt(failed: DataFrame, base_seconds: int = 60, most: int = 3) -> DataFrame:
    """Due time after exponential back-off; no row beyond ``most`` retries."""
    wait = F.make_interval(secs=(base_seconds * F.pow(F.lit(2), "retry_count")).cast("int"))
    return failed.where(F.col("retry_count") < most).withColumn("due_at", (F.col("failed_at") + wait).cast("timestamp"))


def crawl_mode(cursors: DataFrame, as_of: Column, max_age_days: int = 25) -> DataFrame:
    """full if there is no token or it is too old, else delta."""
    old = F.col("delta_token").isNull() | (F.col("token_obtained_at") < as_of - F.make_interval(days=F.lit(max_age_days)))
    return cursors.withColumn("mode", F.when(old, "full").otherwise("delta"))


def replay_flag(dispatched: DataFrame) -> DataFrame:
    """Drives whose cursor must be reset since a change was skipped."""
    return dispatched.groupBy("drive_id").agg(F.max((~F.col("dispatched")).cast("int")).cast("boolean").alias("reset_cursor"))


def advance_cursors(cursors: DataFrame, runs: DataFrame) -> DataFrame:
    """Cursors after their drives' runs: new token and time, items added up."""
    rows = cursors.join(runs, "drive_id", "full_outer")
    return rows.select(
        "drive_id",
        F.coalesce("new_token", "delta_token").alias("delta_token"),
        F.coalesce("run_at", "last_sync_at").alias("last_sync_at"),
        (F.coalesce("items_processed", F.lit(0)) + F.coalesce("items", F.lit(0))).alias("items_processed"),
        F.when(F.col("was_full"), F.col("run_at")).otherwise(F.col("full_crawl_at")).alias("full_crawl_at"),
    )


def audit(changes: DataFrame, processed_at: Column) -> DataFrame:
    """Append-only event rows of the changes, with the error of those that failed."""
    error = F.col("error") if "error" in changes.columns else F.lit(None).cast("string")
    return changes.where("change is not null").select(*key_of(changes), F.col("change").alias("change_type"), F.col("name").alias("file_name"), F.col("modified_at").alias("detected_at"), processed_at.alias("processed_at"), F.substring(error, 1, 1000).alias("error"))


def delete_documents(rows: DataFrame, gone: DataFrame, key: str = "document_id") -> DataFrame:
    """``rows`` without those of the deleted documents (chunks, grants, access alike)."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")
