"""Classification and application of feed items, as data."""

import datetime

from pyspark.sql import functions as F

from docloom.operators import changes

AT = datetime.datetime(2024, 1, 1)
SCHEMA = "position long, item_id string, drive_id string, name string, is_deleted boolean, is_folder boolean, ctag string, etag string, parent_path string, modified_at timestamp"
STORED = "item_id string, drive_id string, ctag string, etag string, status string, retry_count long, content_hash string"
ITEMS = [
    ("known-deleted", "a.pdf", True, False, None, None, "DELETED"),
    ("folder", "x", False, True, None, None, None),
    ("picture", "image.png", False, False, "c", "e", None),
    ("new", "report.pdf", False, False, "c", "e", "CREATED"),
    ("updated", "a.docx", False, False, "new", "e", "UPDATED"),
    ("permission", "a.docx", False, False, "c", "new", "PERMISSION_CHANGED"),
    ("same", "a.docx", False, False, "c", "e", None),
    ("unknown-deleted", "a.pdf", True, False, None, None, None),
    ("tombstone", "a.pdf", False, False, "c", "e", "CREATED"),
    ("no-ctag", "a.pdf", False, False, None, "new", "PERMISSION_CHANGED"),
]


def _tables(spark):
    feed = [(i, k, "d", n, dl, fo, c, e, "/p", AT) for i, (k, n, dl, fo, c, e, _) in enumerate(ITEMS)]
    stored = [(k, "d", "c", "e", "deleted" if k == "tombstone" else "completed", 2, "h") for k, *_ in ITEMS if k not in ("new", "unknown-deleted", "folder", "picture")]
    return spark.createDataFrame(feed, SCHEMA), spark.createDataFrame(stored, STORED)


def test_classify(spark):
    feed, stored = _tables(spark)
    got = {r.item_id: r.change for r in changes.classify(feed, stored).collect()}
    assert got == {k: x for k, *_, x in ITEMS}


def test_apply(spark):
    feed, stored = _tables(spark)
    got = {r.item_id: r for r in changes.apply(stored, changes.classify(feed, stored)).collect()}
    assert got["new"].status == "pending" and got["new"].ctag == "c"
    assert got["updated"].ctag == "new" and got["updated"].retry_count == 0
    assert got["known-deleted"].status == "deleted"
    assert got["permission"].etag == "new" and got["permission"].status == "completed"
    assert got["same"].etag == "e"


def test_last_item_counts(spark):
    feed, stored = _tables(spark)
    again = feed.where("item_id = 'updated'").withColumns({"position": F.lit(99).cast("long"), "is_deleted": F.lit(True)})
    rows = changes.last_per_key(feed.unionByName(again))
    assert changes.classify(rows, stored).where("item_id = 'updated'").first().change == "DELETED"
    assert rows.count() == len(ITEMS)


def test_empty(spark):
    feed, stored = _tables(spark)
    assert changes.apply(stored.limit(0), changes.classify(feed.limit(0), stored)).count() == 0
