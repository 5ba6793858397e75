"""Extra columns with the names that operators use inside change nothing."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from docloom.llm import decontam, html_extract, minhash, mixing, pii, pq_dedup, rlz_dedup, token_counts, tokenbin, toxicity

CLASH = ["digest", "key", "node", "bands", "sample", "n", "data", "block", "bucket", "shard", "first", "score", "toxic", "spans", "copy", "copies", "slot", "turns", "v", "list", "component", "text_b", "found"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i % 9, f"word{i % 4} and some text of row {i % 5} that goes on for a while, me{i}@x.com", "s" + str(i % 2)) for i in range(12)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def _labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, toxic int")


OPS = {
    "pii": lambda s, d: pii.find(d),
    "decontam": lambda s, d: decontam.contamination(d, d.select(F.col("doc_id").alias("item_id"), "text", *[c for c in d.columns if c in CLASH])),
    "tokenbin": lambda s, d: tokenbin.round_trip(d, P.path("byte_bpe_50k.json")),
    "toxicity": lambda s, d: toxicity.score(d, _labels(s)),
    "token_counts": lambda s, d: token_counts.count_tokens(d, P.path("piece_bpe_32k.model")),
    "rlz": lambda s, d: rlz_dedup.dedup(d, 4, 2),
    "minhash": lambda s, d: minhash.near_duplicates(d),
    "html": lambda s, d: html_extract.extract(d.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"), *[c for c in d.columns if c in CLASH])),
    "pq": lambda s, d: pq_dedup.near_duplicates(d.select(F.col("doc_id").alias("vec_id"), F.array(F.length("text").cast("double"), F.lit(1.0)).alias("embedding"), *[c for c in d.columns if c in CLASH])),
    "mixing": lambda s, d: mixing.mixed(d, block_rows=2).select("doc_id", "source", "block", "place", "slot"),
}


@pytest.mark.parametrize("name", sorted(OPS))
def test_clashing_columns(spark, docs, name):
    plain = sorted(map(repr, OPS[name](spark, docs).collect()))
    extra = docs.withColumns({c: F.lit("x") for c in CLASH})
    assert sorted(map(repr, OPS[name](spark, extra).collect())) == plain
