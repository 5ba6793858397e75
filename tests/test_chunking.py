"""Properties of the packers and small cases of the other chunkers."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import hooks, vectors
from docloom.operators import chunking


def _pack(spark, texts, most, overlap):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    return {r.id: r.c for r in df.select("id", chunking.pack(chunking.paragraphs(F.col("t")), most, overlap).alias("c")).collect()}


def _by_hand(parts, most, overlap):
    out, held, n = [], [], 0
    for p in parts:
        lines = [x.strip() for x in p.split("\n") if x.strip()]
        size = len(p.split())
        if lines and all(x.startswith("|") and x.endswith("|") for x in lines):
            if held:
                out.append("\n\n".join(held))
            out.append(p)
            held, n = [], 0
            continue
        if held and n + size > most:
            out.append("\n\n".join(held))
            kept, k = [], 0
            for q in reversed(held):
                if k + len(q.split()) > overlap:
                    break
                kept.insert(0, q)
                k += len(q.split())
            held, n = kept, k
        held.append(p)
        n += size
    if held:
        out.append("\n\n".join(held))
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["a b c", "one two", "x", "| a | b |", "w w w w w w"]), max_size=9), min_size=1, max_size=12))
def test_pack_equals_a_loop(spark, docs):
    got = _pack(spark, ["\n\n".join(d) for d in docs], 8, 3)
    for i, d in enumerate(docs):
        parts = d if len(d) > 1 else d
        assert [c.content for c in got[i]] == _by_hand(parts, 8, 3)


def test_empty_and_short(spark):
    got = _pack(spark, ["", "One sentence.", "intro\n\n| a | b |\n| c | d |\n\ntext"], 600, 60)
    assert got[0] == [] and len(got[1]) == 1
    assert [c.content for c in _pack(spark, ["0 first 100\n\n1 second 11"], 1, 0)[0]] == ["0 first 100", "1 second 11"]
    assert [c.kind for c in got[2]] == ["text", "table", "text"]


def test_summary_first(spark):
    df = spark.createDataFrame([(1, "a\n\nb", "sum"), (2, None, None)], "document_id long, text string, summary string")
    rows = chunking.chunk_documents(df).orderBy("document_id", "sequence_number").collect()
    assert [(r.sequence_number, r.chunk_type) for r in rows] == [(-1, "summary"), (0, "text")]


def test_sheet_header_repeats(spark):
    df = spark.createDataFrame([(1, "s", ["h1", "h2"], [[str(i), "x"] for i in range(10)])], "document_id long, name string, headers array<string>, rows array<array<string>>")
    rows = chunking.sheet_chunks(df, 20).orderBy("part").collect()
    assert len(rows) > 1 and all(r.content.startswith("| h1 | h2 |") for r in rows)
    assert sum(r.content.count("| x |") for r in rows) == 10


def test_chart_text(spark):
    s = F.array(F.struct(F.lit("s").alias("name"), F.array(*[F.lit(float(i)) for i in range(12)]).alias("values")))
    out = spark.range(1).select(chunking.chart_text(F.lit("bar"), F.lit("T"), F.array(F.lit("a")), s)).first()[0]
    assert out.splitlines()[0] == "[bar] T" and out.count(",") == 9


def test_page_merge(spark):
    m = lambda *a: spark.range(1).select(chunking.page_merge(*[F.lit(x) for x in a[:3]], F.lit(a[3]))).first()[0]
    assert m("p", "md", None, False) == "md" and m("p", None, None, False) == "p"
    assert m("p", "md", "NONE", True) == "p" and m("p", "md", "seen", True) == "p\n\nseen"


def test_merge_small_slides(spark):
    df = spark.createDataFrame([(1, 1, "a b"), (1, 2, "c " * 25), (1, 3, "end")], "document_id long, slide long, content string")
    rows = chunking.merge_small_slides(df).orderBy("first_slide").collect()
    assert [r.first_slide for r in rows] == [1, 3] and rows[0].content.startswith("a b\n\n---\n\nc")


def test_sections_over_the_limit_are_packed(spark):
    text = "Intro\n\none two\n\nthree four\n\nfive six\nsee Intro here\nEnd\nlast"
    cut = lambda **k: [tuple(x) for x in spark.range(1).select(chunking.section_parts(F.lit(text), F.array(F.lit("Intro"), F.lit("End")), **k)).first()[0]]
    assert cut() == [("Intro\n\none two\n\nthree four\n\nfive six\nsee Intro here", "Intro", "text"), ("End\nlast", "End", "text")]
    assert [x[0] for x in cut(inside=True)] == ["Intro\n\none two\n\nthree four\n\nfive six", "see Intro here", "End\nlast"]
    packed = cut(most=4, overlap=0)
    assert [x[1] for x in packed] == ["Intro"] * 3 + ["End"] and packed[0][0] == "Intro\n\none two"


def test_sections_of_a_long_text_take_linear_time(spark):
    import time

    text = "\n".join(f"Part {i // 6}" if i % 6 == 0 else f"line {i}" for i in range(9000))
    df = spark.createDataFrame([(text,)], "text string").select(F.explode(chunking.section_parts(F.col("text"), F.array(*[F.lit(f"Part {i}") for i in range(0, 1500, 10)]), most=10**6)).alias("c"))
    start = time.time()
    rows = df.collect()
    assert time.time() - start < 30
    assert [r.c.heading for r in rows] == [f"Part {i}" for i in range(0, 1500, 10)]
    assert "\n".join(r.c.content for r in rows) == text


def test_sentence_pairs_equal_the_default_embeddings(spark):
    """Against the vectors of ``hooks.hashed_vector``, one sentence at a time; the words are
    not counted place by place."""
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "Bc", "\u00e9t\u00e9", "K\u212a", "x1y", "\u0130z", "9", "\U0001f600", "the"])
    texts = [" ".join(word() + rng.choice(["", ".", "! X", "?\u00a0Y", ".\nZ"]) for _ in range(rng.randrange(30))) for _ in range(700)]
    docs = spark.createDataFrame([*enumerate([*texts, "", None, "no end", "A. B. 9. C", "a"])], "document_id long, text string").repartition(3)
    v = docs.select("document_id", F.posexplode(chunking.sentences(F.col("text"))).alias("s", "t")).select("document_id", "s", hooks.hashed_vector(F.col("t"), 32).alias("v"))
    near = F.round(vectors.cosine("v", F.lead("v").over(Window.partitionBy("document_id").orderBy("s"))), 6)
    want = sorted(map(repr, (tuple(r) for r in v.select("document_id", "s", near).collect())))
    out = chunking.sentence_pairs(docs)
    assert sorted(map(repr, (tuple(r) for r in out.collect()))) == want
    assert chunking.sentence_pairs(docs.limit(0)).count() == 0
    assert "md5" not in out._jdf.queryExecution().executedPlan().toString()
