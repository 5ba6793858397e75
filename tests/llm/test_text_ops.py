"""Personal data, contamination, toxicity, main text: against plain rules."""

import hashlib
import re

import numpy as np
import pytest

from docloom.llm import decontam, html_extract, pii, toxicity
from docloom.llm import queries as Q
from tests.compare import rows_equal

SF = "/root/testdata/sf0.01"
RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def _base(text):
    out, n = [], []
    for kind, rule in RULES.items():
        own = 0
        for m in re.finditer(rule, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (16 <= len(d) <= 19 and _luhn(d)) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
            own += 1
        n.append(own)
    return out, n


def test_pii_base_spans(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = Q.op1_pii(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base, n = _base(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == n
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r.spans.split(","))


def test_pii_em_finds_the_unreliable_labeler():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    vote = np.stack([np.where(rng.random(4000) < p, truth, ~truth) for p in (0.95, 0.9, 0.9, 0.85, 0.55)], 1).astype(int)
    post, table = pii.reliabilities(vote, np.zeros(4000, int), np.ones(4000))
    assert ((post > 0.5) == truth).mean() > 0.95
    assert table[0, 0, 1, 1] > 0.9 > 0.7 > table[0, 4, 1, 1]


def test_pii_edges(spark):
    rows = [(1, None), (None, "me@x.com"), (2, ""), (2, "call 555-123-4567 or Dr. John Smith, token = \"0123456789abcdef0123\"")]
    got = {(r.doc_id, len(r.spans)) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d for d, _ in got} == {1, None, 2} and (None, 1) in got
    assert pii.find(spark.createDataFrame(rows, "doc_id long, text string").limit(0)).count() == 0


def test_contamination_equals_sql(spark):
    rows_equal(Q.op2_decontamination(spark, SF), Q.ORACLES["op2_decontamination"], SF)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _plain(docs, items):
    words = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            grams.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = []
    for d, t in docs:
        w = words(t)
        hit, found = [0] * len(w), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in grams:
                    found |= grams[g]
                    hit[k : k + n] = [1] * n
        out.append((d, len(w), sum(hit), tuple(sorted(found))))
    return sorted(out, key=str)


@pytest.mark.parametrize("phrase_bytes", [1 << 23, 900])
def test_contamination_equals_loops(spark, phrase_bytes):
    rng = np.random.default_rng(1)
    docs = [(i % 50 if i % 7 else None, " ".join(rng.choice(["a", "b", "c", "D", "é"], rng.integers(0, 40))) if i % 11 else None) for i in range(60)] + [(3, "a b c")] * 3
    items = [(i, " ".join(rng.choice(["a", "b", "c", "É", "é"], rng.integers(0, 14)))) for i in range(20)]
    found = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (None, "a b")], "item_id long, text string"), phrase_bytes=phrase_bytes)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"]))) for r in found.collect()), key=str) == _plain(docs, items)


def test_no_items_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontam.contamination(docs, items.limit(0)).first().n_hit == 0
    assert decontam.contamination(docs.limit(0), items).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red x green y blue"), (2, "red x x x x x x green"), (3, "blue green red")], "doc_id long, text string")
    terms = {b"red", b"green", b"blue"}
    found = decontam.search(decontam.build_index(docs, terms), [b"red green blue"], terms, within=4)
    assert {r.doc_id for r in found.collect() if r.starts} == {1, 3}


def test_toxicity_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = toxicity.score(docs, labels).where("held_out").join(labels.select("doc_id", "toxic"), "doc_id").collect()
    right = sum((r.score >= 0.5) == (r.toxic == 1) for r in rows) / len(rows)
    false = [r.score >= 0.5 for r in rows if r.toxic == 0]
    assert right > 0.95 and sum(false) / len(false) < 0.02


def test_deobfuscation():
    corpus = np.zeros(28**3)
    model = toxicity.char_model(corpus, ["idiot", "clown", "moron", "scum", "worthless", "trash"])
    for token, word in [("1d10t", "idiot"), ("cl0wn", "clown"), ("m0r0n", "moron"), ("$cum", "scum"), ("idiooot", "idiot"), ("worth1ess", "worthless"), ("tra$h", "trash")]:
        assert toxicity.decode(token, model) == word
    assert {"idiot", "clown", "m0r0n", "iiidiot"} <= {word for word, _ in toxicity.suspects("you i d i o t and c-l-o-w-n athe*** m0r0n!! iiidiot")}
    assert toxicity.suspects("a plain text, with 3 words!") == []


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (None, "x"), (2, ""), (3, "you idiot")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.score(docs, labels).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(docs.limit(0), labels).count() == 0


def test_html_equals_article(spark):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in Q.op10_html_text(spark, SF).collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", b)).split()) for b in re.split("<br>|</?p>|</?h1>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_html_without_marks():
    page = """<html><body><header>Site</header><div class="menu"><a href=x>Home</a></div><div id=content><h2>Title</h2><p>First long paragraph of the story with lots of words
    &amp; entities, more text follows here to be long enough.<p>Second long paragraph with a <a href=#>link</a> in it, and again enough text.</div><div class="comments"><p>I am a reader comment that
    is quite long and should not be included at all.</p></div><form><label>Mail</label></form><footer>Copyright long footer</footer></body></html>"""
    assert html_extract.main_text(page).splitlines()[0] == "Title" and "comment" not in html_extract.main_text(page) and "& entities" in html_extract.main_text(page)
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<p></p>") == ""
    assert html_extract.main_text("<article><p>a<script>if (x < 1) {'</p>'}</script> b<br>c</article>") == "a b c"
