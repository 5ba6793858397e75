"""Every stage with nulls in any column, repeated rows, long texts, clashing columns, no rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["_row", "_bad", "node", "key", "digest", "slot", "block", "place", "score", "release", "_mx_s", "_mx_id", "_mx_rank", "_mx_at", "_mx_doc", "_mx_range", "_found", "class_id"]
ROWS = [
    (None, None, None, None, None),
    (None, "a text of its own without an id", None, "s", 3),
    (1, None, "en", "s", None),
    (2, "", "en", None, 0),
    (3, "twice the same row of some words here", "en", "s", 5),
    (3, "twice the same row of some words here", "en", "s", 5),
    (4, " ".join(f"word{i}" for i in range(60_000)), "en", "t", 9),
    (5, "x" * 300_000, "en", "t", 9),
]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, name, tmp_path):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.createDataFrame(ROWS, SCHEMA)
    rows = stage(spark, docs, SF).collect()
    want = len(ROWS) - (name == "minhash_near_dedup")
    assert len(rows) == want
    assert stage(spark, docs.limit(0), SF).count() == 0
    extra = docs.withColumns({c: F.lit("x") for c in CLASH}).withColumn("m", F.create_map(F.lit("a"), F.col("doc_id")))
    out = stage(spark, extra, SF)
    assert out.count() == want
    if name != "token_output":
        assert out.columns == extra.columns
        assert out.where(" and ".join(f"{c} = 'x'" for c in CLASH)).count() == want
