"""Exact dedup by content sort against a grouping in plain Python."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from docloom.llm import content_sort
from docloom.llm import queries as Q
from tests.compare import rows_equal

SCHEMA = "doc_id long, text string"


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def _want(rows, largest):
    """Rows (doc_id, keep_id, group_size, sha256) and how many stay of each group."""
    groups = defaultdict(list)
    for d, t in rows:
        groups[_lower(t)].append(d)
    out = []
    for t, ids in groups.items():
        known = [d for d in ids if d is not None]
        keep = (max if largest else min)(known) if known else None
        out += [(d, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for d in ids]
    return sorted(out, key=repr), len(groups)


def _check(spark, rows, largest):
    got = content_sort.exact_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), largest=largest).collect()
    want, groups = _want(rows, largest)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == groups == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


@pytest.mark.parametrize("largest", [False, True])
def test_groups_over_many_partitions(spark, largest):
    """One group holds a third of all rows, another a fifth; starts are shared."""
    rng = random.Random(1)
    long = "the same long beginning of very many texts, which the range key does not go beyond " * 3
    rows = [(i, "HOT Text" if i % 3 == 0 else "hot text" if i % 7 == 0 else long + "Copy" if i % 5 == 0 else long + str(rng.randrange(900))) for i in range(3000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        _check(spark, rows, largest)
        dealt = spark.createDataFrame(rows, SCHEMA).where("text = 'hot text' or text = 'HOT Text'")
        assert content_sort.exact_duplicates(dealt).count() == dealt.count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_equal_keys_of_different_texts(spark, monkeypatch):
    """Texts are compared, not digests: one digest and one start for all of them."""
    monkeypatch.setattr(content_sort, "HEAD", 0)
    monkeypatch.setattr(content_sort.F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _check(spark, [(i, f"t{i % 7}") for i in range(200)], True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("largest", [False, True])
def test_edges(spark, largest):
    rows = [(1, None), (2, ""), (None, ""), (None, "a"), (None, "A"), (5, "É"), (6, "é"), (7, "x" * 300_000), (8, "X" * 300_000), (9, "same"), (9, "Same"), (9, "same"), (-3, "same"), (10, "a\x00b"), (11, "a\nb"), (12, "a\nb ")]
    _check(spark, rows, largest)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert content_sort.exact_duplicates(docs.limit(0)).count() == 0
    plain = sorted(map(repr, content_sort.exact_duplicates(docs).collect()))
    extra = docs.withColumns({c: F.lit("x") for c in ("t", "head", "digest", "part", "run", "kept", "keep_id", "group_size", "p", "r", "first", "own", "all")})
    assert sorted(map(repr, content_sort.exact_duplicates(extra).collect())) == plain


def test_equals_sql(spark):
    rows_equal(Q.op13_exact_dedup(spark, "/root/testdata/sf0.01"), Q.ORACLES["op13_exact_dedup"], "/root/testdata/sf0.01")
