"""The pipeline against its stages' plain meaning on a small table."""

import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from docloom.llm import decontam, minhash, mixing, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_and_result(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, kept, SF)
        assert out.columns == columns
        out.write.parquet(str(tmp_path / f"{k}-{name}"))
        before, kept = kept, spark.read.parquet(str(tmp_path / f"{k}-{name}"))
        ids = {r.doc_id for r in kept.select("doc_id").collect()}
        had = {r.doc_id for r in before.select("doc_id").collect()}
        if k == 0:
            bad = {r.doc_id for r in toxicity.score(before, spark.read.parquet(f"{SF}/labels.parquet")).where("score >= 0.5").collect()}
        elif k == 1:
            bad = {r.doc_id for r in minhash.near_duplicates(before).where("not kept").collect()}
            assert bad
        elif k == 2:
            bad = {r.doc_id for r in decontam.contamination(before, spark.read.parquet(f"{SF}/benchmark.parquet")).where("n_hit > 0").collect()}
        else:
            bad = set()
        assert ids == had - bad
    order = [r.doc_id for r in mixing.mixed(spark.read.parquet(str(tmp_path / "2-decontamination"))).orderBy("slot", "place").collect()]
    text = {r.doc_id: r.text for r in docs.collect()}
    tok, at, want = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0, []
    for d in order:
        ids = [*tok.encode(text[d], add_special_tokens=False).ids, 0]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    last = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert sorted(map(tuple, last.collect())) == sorted(want)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(want)
