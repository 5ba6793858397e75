"""The pipeline's filters judge rows, not ids."""

from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import toxicity

SF = "/root/testdata/sf0.1"
LONG = "one two three four five six seven eight nine ten eleven twelve"


def _texts(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.collect())


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_contaminated_row_goes_alone(spark, tmp_path):
    spark.createDataFrame([(1, LONG)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = _docs(spark, [(None, LONG, "a"), (None, "clean", "a"), (5, f"x {LONG}", "a"), (5, "fine", "b"), (6, None, "a")])
    assert _texts(corpus_pipeline.decontaminate(spark, docs, str(tmp_path))) == [(False, 5, "fine"), (False, 6, ""), (True, 0, "clean")]


def test_one_row_of_a_class_stays(spark):
    docs = _docs(spark, [(7, LONG, "a"), (7, LONG, "a"), (None, LONG, "a"), (9, LONG, "b"), (None, "alone here", "a"), (None, "other copy", "a"), (None, "other copy", "a"), (7, "quite different", "c"), (3, None, "a"), (3, None, "a"), (4, "?!", "a")])
    want = [(False, 3, ""), (False, 3, ""), (False, 4, "?!"), (False, 7, LONG), (False, 7, "quite different"), (True, 0, "alone here"), (True, 0, "other copy")]
    assert _texts(corpus_pipeline.drop_near_duplicates(spark, docs, SF)) == want


def test_toxic_row_goes_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    worst = toxicity.score(docs, spark.read.parquet(f"{SF}/labels.parquet")).orderBy(F.desc("score")).first()
    assert worst.score >= 0.5
    toxic = docs.where(F.col("doc_id") == worst.doc_id).withColumn("doc_id", F.lit(None).cast("long"))
    both = docs.unionByName(toxic).unionByName(toxic.withColumn("text", F.lit("a plain clean text")))
    left = corpus_pipeline.reject_toxic(spark, both, SF).where("doc_id is null").collect()
    assert [r.text for r in left] == ["a plain clean text"]
