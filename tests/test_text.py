"""Query-analysis and naming cases, as data."""

import datetime

import pytest
from pyspark.sql import functions as F

from docloom.functions import text

CASES = [
    ("What is our PTO policy?", "factual", "hr", "cosine", None),
    ("How to submit an expense report?", "procedural", "finance", "mmr", None),
    ("Compare Q3 vs Q4 sales trends", "analytical", None, "hyde_cosine", None),
    ("Create a presentation about Q4 sales", "generative", None, "cosine", "pptx"),
    ("What is our leave policy?", "factual", "hr", "cosine", None),
    ("Show me the latest budget report", "factual", "finance", "cosine", None),
    ("What's the current pipeline value?", "factual", "sales", "cosine", None),
    ("What campaigns are running?", "factual", None, "cosine", None),
    ("Tell me about the company", "factual", None, "cosine", None),
    ("Generate a report document", "generative", None, "cosine", "docx"),
    ("Create a spreadsheet with budget data", "generative", "finance", "cosine", "xlsx"),
    ("Steps to onboard a new employee", "procedural", None, "mmr", None),
    ("Thanks!!", "smalltalk", None, "cosine", None),
]


def test_query_analysis(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES], "q string")
    kind = text.query_type(F.col("q"))
    got = {r.q: tuple(r)[1:] for r in df.select("q", kind, text.department(F.col("q")), text.strategy(kind), text.document_type(F.col("q"))).collect()}
    assert got == {c[0]: c[1:] for c in CASES}


@pytest.mark.parametrize("name,ext", [("report.pdf", "pdf"), ("README", ""), ("file.backup.xlsx", "xlsx"), ("FILE.PDF", "pdf")])
def test_extension(spark, name, ext):
    assert spark.range(1).select(text.file_extension(F.lit(name))).first()[0] == ext


@pytest.mark.parametrize(
    "q,since,until",
    [
        ("last 7 days", "2024-05-08", "2024-05-15"),
        ("this week", "2024-05-13", "2024-05-15"),
        ("last week", "2024-05-06", "2024-05-13"),
        ("last month", "2024-04-01", "2024-05-01"),
        ("last quarter", "2024-01-01", "2024-04-01"),
        ("last year", "2023-01-01", "2024-01-01"),
        ("in Q4 2022", "2022-10-01", "2023-01-01"),
        ("since 2020", "2020-01-01", "2024-05-15"),
        ("in 2021", "2021-01-01", "2022-01-01"),
        ("last 1 day", "2024-05-14", "2024-05-15"),
        ("within 2021", None, None),
        ("nothing", None, None),
    ],
)
def test_date_range(spark, q, since, until):
    a, b = text.date_range(F.lit(q), F.lit("2024-05-15").cast("timestamp"))
    r = spark.range(1).select(a.cast("string"), b.cast("string")).first()
    day = lambda s: s and datetime.datetime.fromisoformat(s).date().isoformat()
    assert (day(r[0]), day(r[1])) == (since, until)


@pytest.mark.parametrize("said,want", [("123456789", "[SSN]"), ("5551234567", "[PHONE]"), ("x 555.123.4567 y", "x [PHONE] y"), ("12345", "12345")])
def test_scrub_without_separators(spark, said, want):
    assert spark.range(1).select(text.scrub(F.lit(said))).first()[0] == want


def test_scrub_and_names(spark):
    r = spark.range(1).select(text.scrub(F.lit("a.b@c.com 123-45-6789 (555) 123-4567")), text.entity_name(F.lit("  A \n B ")), text.entity_name(F.lit("x")), text.last_folder(F.lit("/drives/1/root:/A/B c/"))).first()
    assert tuple(r) == ("[EMAIL] [SSN] ([PHONE]", "A B", None, "B c")
