"""A corpus pipeline of five operators; each stage's table is written and reread.

All stages but the last return the columns of ``documents``.  A row is judged by
itself: filters run on a digest of all its columns, so rows that share a ``doc_id`` or
have none do not go with one another.  The digest has 64 bits, as the operators' ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontam, minhash, mixing, tokenbin, toxicity
from docloom.llm import queries as Q
from docloom.llm.common import written


#: Words whose ids an encoder of the token output remembers.
WORDS = 300_000


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a further column, named by the second, which only identical rows share."""
    name = "_row"
    while name in (c.lower() for c in docs.columns):
        name += "_"
    # maps have no hash of their own
    value = lambda f: F.to_json(F.struct(docs[f.name])) if "map<" in f.dataType.simpleString() else docs[f.name]
    return docs.withColumn(name, F.xxhash64(*map(value, docs.schema.fields), *[docs[c].isNull() for c in docs.columns])), name


def _without(keyed: DataFrame, key: str, bad: DataFrame) -> DataFrame:
    """``keyed`` but the rows in ``bad``, whose ``doc_id`` is the row's digest."""
    bad = bad.select(F.col("doc_id").alias("_bad")).distinct()
    return keyed.join(bad, keyed[key] == bad["_bad"], "left_anti").drop(key)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go."""
    docs, key = _keyed(docs)
    scored = toxicity.score(docs, Q.table(spark, sf_dir, "labels"), id_col=key)
    return _without(docs, key, scored.where("score >= 0.5"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every near-duplicate class one document with the smallest id stays, a null id
    only where there is no other; documents without words are in no class and stay."""
    columns, (docs, key) = docs.columns, _keyed(docs)
    worded = F.coalesce(F.col("text").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"), F.lit(False))
    rows = docs.where(worded)
    found = minhash.near_duplicates(docs.select("text", F.col(key).alias("doc_id"))).select(F.col("doc_id").alias("_found"), F.col("class_id").alias("_class")).distinct()
    own = rows.select(F.col(key).alias("_own"), F.col("doc_id").cast("long").alias("_id")).distinct()
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_own"))
    kept = own.join(found, own["_own"] == found["_found"]).groupBy("_class").agg(first.alias("first")).select(F.col("first._own").alias("_kept"))
    rows = rows.join(kept, rows[key] == kept["_kept"], "left_semi").dropDuplicates([key])
    return docs.where(~worded).unionByName(rows).select(*columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    docs, key = _keyed(docs)
    found = decontam.contamination(docs.select("text", F.col(key).alias("doc_id")), Q.table(spark, sf_dir, "benchmark"), within=None)
    return _without(docs, key, found.where("n_hit > 0"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture: the written files hold it."""
    return mixing.in_order(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, in binary blocks, read back.

    The ids stand in the order in which the mixture wrote its files; documents that
    come from no files are ordered by id."""
    order = None
    if docs.inputFiles():
        # part numbers have more digits than others from 100,000 files on
        part = F.regexp_extract(F.col("_metadata.file_name"), "part-([0-9]+)", 1).try_cast("long")
        docs = docs.withColumns({"_mx_part": part, "_mx_row": F.col("_metadata.row_index"), "_mx_file": F.col("_metadata.file_name")})
        order = [F.col("_mx_part"), F.col("_mx_row"), F.col("_mx_file")]
    # the workers hold what earlier stages have left, so the word cache is smaller here
    return tokenbin.round_trip(docs, Q.tokenizer("byte_bpe_50k.json"), order=order, words=WORDS)


STAGES = [
    ("toxicity", reject_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("source_mix", mix_sources),
    ("token_output", token_output),
]

#: No SQL can train a classifier or encode text with a learned vocabulary.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every earlier stage is written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
