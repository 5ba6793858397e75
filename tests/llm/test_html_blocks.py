"""Main text by line blocks: marks are weights, names are read word by word."""

import re
import time

import pytest

from docloom.llm import html_extract as H
from docloom.llm import queries as Q

SF = "/root/testdata/sf0.01"
LONG = "word " * 30


def test_article_marks_change_nothing_on_pages(spark):
    pages = [r.html for r in Q.table(spark, SF, "pages").collect()]
    assert all("<article>" in p for p in pages)
    assert [H.main_text(p) for p in pages] == [H.main_text(re.sub("</?article>", "", p)) for p in pages]


def test_names_with_other_words_are_content():
    page = '<article><h1>T</h1><div class="social-science">a</div><section id="related-work">b</section><div class="social-share">no</div><div id="comment-12">no</div><p>c</p></article>'
    assert H.main_text(page) == "T\na\nb\nc"


def test_link_line_between_surge_and_dive_stays():
    page = f"<div>{LONG}</div><p><a>a line that is one link</a></p><div>{LONG}</div><ul><li><a>one</a></li><li><a>two</a></li><li><a>three</a></li></ul><p>far</p>"
    assert H.main_text(page) == f"{LONG.strip()}\na line that is one link\n{LONG.strip()}"


def test_regions_below_the_threshold_go():
    gap = "<nav>x</nav>" * 3
    assert H.main_text(f"<div>site</div>{gap}<h2>Head</h2><p>{LONG}</p><p>End.</p>{gap}<div>small print</div>") == f"Head\n{LONG.strip()}\nEnd."


def _loops(masses: list[int]) -> list[int]:
    """Kept lines of plain lengths, by the definition."""
    sums = [sum(masses[i : i + H.WINDOW]) for i in range(len(masses))]
    limit, kept, run = min(H.SURGE, max(sums, default=0) // 2), [], []
    for i, s in enumerate([*sums, 0]):
        if s:
            run.append(i)
        else:
            if run and max(sums[k] for k in run) > limit:
                kept += [k for k in run if masses[k]]
            run = []
    return kept


@pytest.mark.parametrize("seed", range(20))
def test_windows_equal_loops(seed):
    import random

    rng = random.Random(seed)
    masses = [rng.choice([0, 0, 0, 3, 20, 60, 120]) for _ in range(40)]
    page = "".join(f"<p>{chr(97 + i % 26) * n}</p>" if n else "<nav>x</nav>" for i, n in enumerate(masses))
    assert H.main_text(page) == "\n".join(chr(97 + k % 26) * masses[k] for k in _loops(masses))


@pytest.mark.parametrize("page", ["<a " * 300_000, "<div>" * 50_000 + "</span>" * 50_000, "<b>" * 50_000 + "<p></p>" * 50_000, "<script " * 100_000, '<a "' * 200_000, "<p " * 100_000 + ">", "x" * 1_000_000])
def test_long_and_malformed_pages_take_seconds(page):
    at = time.time()
    H.main_text(page)
    assert time.time() - at < 10


def test_edges(spark):
    rows = [(1, "u", None), (1, "u", "<p>a</p>"), (None, None, ""), (2, "v", "<p>a</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in H.extract(df).collect())
    assert got == [(0, "", "", 0), (1, "u", "", 0), (1, "u", "a", 1), (2, "v", "a", 1)]
    assert H.extract(df.limit(0)).count() == 0
