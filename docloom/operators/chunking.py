"""Documents to chunks, as column expressions: a document never leaves its task.

The sequential packers are folds over an array of paragraphs with a struct as state,
so no Python runs there and no shuffle happens; ``posexplode`` ends each of them.  Limits are
in tokens, by ``functions.text.token_count``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from docloom.functions.text import token_count

#: Documents whose words a task holds at once, and words whose hashes it keeps.
DOCUMENTS, HELD_WORDS = 512, 1 << 18
# Limits of chunks and slides, in tokens.
TARGET, MOST, OVERLAP, SLIDE_LEAST = 450, 600, 60, 20


def paragraphs(text: Column) -> Column:
    """Trimmed parts between blank lines; between lines if there are no blank ones."""
    clean = lambda sep: F.filter(F.transform(F.split(text, sep), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(text.contains("\n\n"), clean("\n\n")).otherwise(clean("\n"))


def is_table(paragraph: Column) -> Column:
    """A pipe table starts with a pipe."""
    return paragraph.startswith("|")


def sentences(text: Column) -> Column:
    """Split after . ! or ? where white space and a capital follow."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+(?=[A-Z])"), lambda x: x != "")


def pack(parts: Column, most: int = MOST, overlap: int = OVERLAP) -> Column:
    """Greedy chunks: array of (content, kind, tokens).

    A paragraph that would overflow flushes what is held; the next chunk starts with the
    longest run of last paragraphs of at most ``overlap`` tokens.  A pipe table is a chunk
    of its own, and nothing is carried over it.
    """
    kind = "struct<out:array<struct<content:string,kind:string,tokens:int>>,held:array<string>,n:int>"
    empty = F.lit(None).cast("array<string>")
    start = F.struct(F.array().cast("array<struct<content:string,kind:string,tokens:int>>").alias("out"), F.coalesce(empty, F.array().cast("array<string>")).alias("held"), F.lit(0).alias("n")).cast(kind)
    chunk = lambda content, what, n: F.array(F.struct(content.alias("content"), F.lit(what).alias("kind"), n.alias("tokens")))

    def flushed(s: Column) -> Column:
        return F.when(F.size(s["held"]) > 0, F.concat(s["out"], chunk(F.concat_ws("\n\n", s["held"]), "text", s["n"]))).otherwise(s["out"])

    def tail(s: Column) -> Column:
        first = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("n"), F.lit(True).alias("open"))

        def step(a: Column, p: Column) -> Column:
            fits = a["open"] & (a["n"] + token_count(p) <= overlap)
            return F.struct(F.when(fits, F.concat(F.array(p), a["kept"])).otherwise(a["kept"]).alias("kept"), F.when(fits, a["n"] + token_count(p)).otherwise(a["n"]).alias("n"), fits.alias("open"))

        return F.aggregate(F.reverse(s["held"]), first, step)

    def step(s: Column, p: Column) -> Column:
        n = token_count(p)
        table = F.struct(F.concat(flushed(s), chunk(p, "table", n)).alias("out"), F.array().cast("array<string>").alias("held"), F.lit(0).alias("n"))
        t = tail(s)
        new = F.struct(flushed(s).alias("out"), F.concat(t["kept"], F.array(p)).alias("held"), (t["n"] + n).alias("n"))
        more = F.struct(s["out"].alias("out"), F.concat(s["held"], F.array(p)).alias("held"), (s["n"] + n).alias("n"))
        return F.when(is_table(p), table).when((F.size(s["held"]) > 0) & (s["n"] + n > most), new).otherwise(more).cast(kind)

    return F.aggregate(parts, start, step, flushed)


def chunk_documents(docs: DataFrame, most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """(document_id, sequence_number, content, chunk_type, token_count) of each text.

    ``docs``: (document_id, text, summary).  A summary is a chunk of its own, number -1.
    """
    rows = docs.select("document_id", "summary", F.posexplode(pack(paragraphs(F.col("text")), most, overlap)).alias("sequence_number", "c"))
    body = rows.select("document_id", F.col("sequence_number").cast("long"), F.col("c.content").alias("content"), F.col("c.kind").alias("chunk_type"), F.col("c.tokens").cast("long").alias("token_count"))
    head = docs.where("summary is not null and summary <> ''").select("document_id", F.lit(-1).cast("long").alias("sequence_number"), F.col("summary").alias("content"), F.lit("summary").alias("chunk_type"), token_count(F.col("summary")).cast("long").alias("token_count"))
    return body.unionByName(head)


def with_context(content: Column, summary: Column, section_summary: Column, heading: Column) -> Column:
    """The chunk after its context prefix; missing parts are skipped."""
    label = lambda name, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(name + ": "), c))
    prefix = F.concat_ws("\n", label("Document Summary", F.substring(summary, 1, 300)), label("Sheet Summary", section_summary), label("Section", heading))
    return F.when(prefix != "", F.concat(prefix, F.lit("\n\n"), content)).otherwise(content)


def section_prefix(chunks: DataFrame, summaries: DataFrame) -> DataFrame:
    """Chunks with the summary of their section, where there is one."""
    return chunks.join(summaries, ["document_id", "heading"], "left")


def split_by_headings(lines: DataFrame, is_heading: Column) -> DataFrame:
    """Segments of consecutive lines; a heading line starts a new one.

    ``lines``: (document_id, line_no, line).  Text before the first heading is segment 0.
    """
    order = Window.partitionBy("document_id").orderBy("line_no")
    seg = F.sum(is_heading.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = lines.withColumn("segment", seg.cast("long")).withColumn("_h", is_heading)
    out = rows.groupBy("document_id", "segment").agg(
        F.max(F.when(F.col("_h"), F.trim(F.regexp_replace("line", "^#+ ", "")))).alias("heading"),
        F.array_sort(F.collect_list(F.when(~F.col("_h"), F.struct("line_no", "line")))).alias("_l"),
    )
    return out.select("document_id", "segment", "heading", F.concat_ws("\n", F.transform("_l", lambda x: x["line"])).alias("content"))


def markdown_heading(line: Column) -> Column:
    return line.rlike("^#{1,6} ")


def known_heading(line: Column, headings: Column, inside: bool = False) -> Column:
    """The trimmed line is one of the document's headings; with ``inside`` it may have one
    anywhere in it."""
    if inside:
        return (F.trim(line) != "") & F.exists(headings, lambda h: line.contains(h))
    return F.array_contains(headings, F.trim(line))


_PART = "array<struct<content:string,heading:string,kind:string>>"


def section_parts(text: Column, headings: Column, inside: bool = False, most: int = MOST, overlap: int = OVERLAP) -> Column:
    """Array of (content, heading, kind): a line that is a known heading starts a segment
    and stays in it; a segment over ``most`` tokens is packed by paragraphs."""
    # as arrays' elements the lines, the headings and the starts are computed once a text
    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))

    def named(line: Column, heads: Column) -> Column:
        if inside:
            return F.when(F.trim(line) != "", F.get(F.filter(heads, lambda h: line.contains(h)), 0))
        return F.when(F.array_contains(heads, F.trim(line)), F.trim(line))

    def segment(said: Column, start: Column, end: Column) -> Column:
        body = F.trim(F.array_join(F.transform(F.slice(said, start + 1, end - start), lambda x: x["line"]), "\n"))
        return F.struct(body.alias("content"), F.get(said, start)["heading"].alias("heading"))

    def cut(said: Column) -> Column:
        at = F.filter(F.transform(said, lambda x, i: F.when((i == 0) | x["heading"].isNotNull(), i)), lambda i: i.isNotNull())
        return once(at, lambda starts: F.transform(starts, lambda start, k: segment(said, start, F.coalesce(F.get(starts, k + 1), F.size(said)))))

    heads = lambda h: F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), named(x, h).alias("heading")))
    segments = once(once(headings, heads), cut)

    def parts(x: Column) -> Column:
        whole = F.array(F.struct(x["content"].alias("content"), x["heading"].alias("heading"), F.lit("text").alias("kind")))
        cut = F.transform(pack(paragraphs(x["content"]), most, overlap), lambda c: F.struct(c["content"].alias("content"), x["heading"].alias("heading"), c["kind"].alias("kind")))
        return F.when(token_count(x["content"]) <= most, whole).otherwise(cut)

    return F.flatten(F.transform(F.filter(segments, lambda x: x["content"] != ""), parts))


def text_parts(text: Column, most: int = MOST, overlap: int = OVERLAP) -> Column:
    return F.transform(pack(paragraphs(text), most, overlap), lambda c: F.struct(c["content"].alias("content"), F.lit(None).cast("string").alias("heading"), c["kind"].alias("kind")))


def _page(p: Column) -> Column:
    text = F.nullif(F.trim(F.coalesce(p["text"], F.lit(""))), F.lit(""))
    vision = F.nullif(F.nullif(F.trim(F.coalesce(p["vision_text"], F.lit(""))), F.lit("")), F.lit("NONE"))
    return F.struct(F.concat_ws("\n\n", text, vision).alias("content"), F.lit(None).cast("string").alias("heading"), F.when(text.isNull(), "image_description").otherwise("text").alias("kind"))


def _slide(s: Column) -> Column:
    body = F.filter(s["content"], lambda x: (x != "") & (x != F.coalesce(s["title"], F.lit(""))))
    head = F.when(F.coalesce(s["title"], F.lit("")) != "", F.concat(F.lit("# "), s["title"]))
    notes = F.when(F.coalesce(s["notes"], F.lit("")) != "", F.concat(F.lit("Notes: "), s["notes"]))
    charts = F.array_join(F.transform(s["charts"], lambda c: chart_text(c["kind"], c["title"], c["categories"], c["series"])), "\n")
    content = F.concat_ws("\n", head, F.nullif(F.array_join(body, "\n"), F.lit("")), F.nullif(charts, F.lit("")), notes)
    return F.struct(content.alias("content"), s["title"].alias("heading"), F.lit("text").alias("kind"))


def _sheet_line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", cells), F.lit(" |"))


def _sheet_groups(headers: Column, rows: Column, most: int) -> Column:
    """Rows as lines, in groups that fit under their header."""
    kind = "struct<out:array<array<string>>,held:array<string>,n:int>"
    start = F.struct(F.array().cast("array<array<string>>").alias("out"), F.array().cast("array<string>").alias("held"), F.lit(0).alias("n")).cast(kind)
    head = token_count(_sheet_line(headers))

    def step(a: Column, r: Column) -> Column:
        n = token_count(r)
        over = (F.size(a["held"]) > 0) & (a["n"] + n + head > most)
        return F.when(over, F.struct(F.concat(a["out"], F.array(a["held"])).alias("out"), F.array(r).alias("held"), n.alias("n"))).otherwise(F.struct(a["out"].alias("out"), F.concat(a["held"], F.array(r)).alias("held"), (a["n"] + n).alias("n"))).cast(kind)

    return F.aggregate(F.transform(rows, _sheet_line), start, step, lambda a: F.when(F.size(a["held"]) > 0, F.concat(a["out"], F.array(a["held"]))).otherwise(a["out"]))


def _sheet(s: Column, most: int) -> Column:
    content = lambda g: F.concat_ws("\n", _sheet_line(s["headers"]), F.array_join(g, "\n"))
    return F.transform(_sheet_groups(s["headers"], s["rows"], most), lambda g: F.struct(content(g).alias("content"), s["name"].alias("heading"), F.lit("table").alias("kind")))


def chunk_parsed(docs: DataFrame, most: int = MOST, overlap: int = OVERLAP, inside: bool = False) -> DataFrame:
    """Chunks of parsed documents, by file type: (document_id, sequence_number, content,
    content_with_context, heading, chunk_type, token_count).

    ``docs``: (document_id, file_type, text, summary, headings array<string>, pages
    array<struct<text, vision_text>>, slides array<struct<title, content array<string>,
    notes, charts>>, sheets array<struct<name, headers, rows>>, section_summaries
    map<string, string>).  pptx goes by slides, xlsx and xlsb by sheets, docx by headings,
    pdf by pages; where those are missing, and for all else, by the text.  A summary is a
    chunk of its own, number -1.  No shuffle.
    """
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    kind, text = F.lower("file_type"), F.coalesce("text", F.lit(""))
    parts = (
        F.when((kind == "pptx") & some("slides"), F.transform("slides", _slide).cast(_PART))
        .when(kind.isin("xlsx", "xlsb") & some("sheets"), F.flatten(F.transform("sheets", lambda s: _sheet(s, most))).cast(_PART))
        .when((kind == "docx") & some("headings"), section_parts(text, F.col("headings"), inside, most, overlap).cast(_PART))
        .when((kind == "pdf") & some("pages"), F.filter(F.transform("pages", _page), lambda p: p["content"] != "").cast(_PART))
        .otherwise(text_parts(text, most, overlap).cast(_PART))
    )
    rows = docs.select("document_id", "summary", "section_summaries", F.posexplode(parts).alias("sequence_number", "c"))
    whole = with_context(F.col("c.content"), F.col("summary"), F.try_element_at("section_summaries", F.coalesce("c.heading", F.lit(""))), F.col("c.heading"))
    body = rows.select("document_id", F.col("sequence_number").cast("long"), F.col("c.content").alias("content"), whole.alias("content_with_context"), F.col("c.heading").alias("heading"), F.col("c.kind").alias("chunk_type"))
    head = docs.where("summary is not null and summary <> ''").select("document_id", F.lit(-1).cast("long").alias("sequence_number"), F.col("summary").alias("content"), F.concat(F.lit("Document Summary: "), "summary").alias("content_with_context"), F.lit(None).cast("string").alias("heading"), F.lit("summary").alias("chunk_type"))
    return body.withColumn("token_count", token_count(F.col("content_with_context")).cast("long")).unionByName(head.withColumn("token_count", token_count(F.col("content")).cast("long")))


def _table_line() -> Column:
    t = F.trim("line")
    return t.startswith("|") & t.endswith("|") & (F.length(t) > 1)


def without_tables(lines: DataFrame) -> DataFrame:
    """(document_id, content): what is left of each document without ``table_runs``."""
    left = F.when(~_table_line(), F.struct("line_no", "line"))
    out = lines.groupBy("document_id").agg(F.array_sort(F.collect_list(left)).alias("_l"))
    return out.select("document_id", F.concat_ws("\n", F.transform("_l", lambda x: F.coalesce(x["line"], F.lit("")))).alias("content"))


def table_runs(lines: DataFrame) -> DataFrame:
    """Runs of consecutive lines that start and end with a pipe, as chunks."""
    order = Window.partitionBy("document_id").orderBy("line_no")
    rows = lines.where(_table_line())
    rows = rows.withColumn("_run", F.col("line_no") - F.row_number().over(order))
    out = rows.groupBy("document_id", "_run").agg(F.min("line_no").alias("first_line"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_l"))
    return out.select("document_id", "first_line", F.concat_ws("\n", F.transform("_l", lambda x: x["line"])).alias("content"))


def page_chunks(pages: DataFrame) -> DataFrame:
    """One chunk a page; only a picture's description makes it image_description."""
    text = F.nullif(F.trim(F.coalesce("text", F.lit(""))), F.lit(""))
    vision = F.nullif(F.nullif(F.trim(F.coalesce("vision_text", F.lit(""))), F.lit("")), F.lit("NONE"))
    out = pages.select("document_id", "page", F.concat_ws("\n\n", text, vision).alias("content"), F.when(text.isNull(), "image_description").otherwise("text").alias("chunk_type"))
    return out.where("content <> ''")


def page_merge(parsed: Column, extracted: Column, vision: Column, visual: Column) -> Column:
    """Page text: extracted Markdown wins, a visual page keeps the parser's text and the
    vision text; vision text NONE is empty."""
    seen = F.nullif(F.trim(F.coalesce(vision, F.lit(""))), F.lit("NONE"))
    kept = F.concat_ws("\n\n", F.nullif(F.coalesce(parsed, F.lit("")), F.lit("")), F.nullif(seen, F.lit("")))
    return F.when(visual, kept).otherwise(F.coalesce(F.nullif(extracted, F.lit("")), parsed, F.lit("")))


def global_pages(batches: DataFrame) -> DataFrame:
    """First global page of each extraction batch: pages of earlier batches plus one."""
    order = Window.partitionBy("document_id").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    return batches.withColumn("first_page", F.coalesce(F.sum("page_count").over(order), F.lit(0)) + 1)


def slide_chunks(slides: DataFrame) -> DataFrame:
    """One chunk a slide: title, lines that are not the title, charts in words, notes."""
    none = "array<struct<kind:string,title:string,categories:array<string>,series:array<struct<name:string,values:array<double>>>>>"
    rows = slides if "charts" in slides.columns else slides.withColumn("charts", F.array().cast(none))
    return rows.select("document_id", "slide", _slide(F.struct("title", "content", "notes", "charts"))["content"].alias("content"))


def merge_small_slides(slides: DataFrame, least: int = SLIDE_LEAST) -> DataFrame:
    """A slide of fewer tokens is joined with the next, whatever that one's size;
    (document_id, first_slide, content)."""
    rows = slides.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("slide", "content"))).alias("s"))
    kind = "struct<out:array<struct<slide:bigint,content:string>>,slide:bigint,held:string>"
    start = F.struct(F.array().cast("array<struct<slide:bigint,content:string>>").alias("out"), F.lit(None).cast("bigint").alias("slide"), F.lit(None).cast("string").alias("held")).cast(kind)
    none = [F.lit(None).cast("bigint").alias("slide"), F.lit(None).cast("string").alias("held")]

    def step(a: Column, s: Column) -> Column:
        both = F.struct(F.concat(a["out"], F.array(F.struct(a["slide"].alias("slide"), F.concat(a["held"], F.lit("\n\n---\n\n"), s["content"]).alias("content")))).alias("out"), *none)
        wait = F.struct(a["out"].alias("out"), s["slide"].alias("slide"), s["content"].alias("held"))
        own = F.struct(F.concat(a["out"], F.array(F.struct(s["slide"].alias("slide"), s["content"].alias("content")))).alias("out"), *none)
        return F.when(a["slide"].isNotNull(), both.cast(kind)).when(token_count(s["content"]) < least, wait.cast(kind)).otherwise(own.cast(kind))

    def finish(a: Column) -> Column:
        return F.when(a["slide"].isNotNull(), F.concat(a["out"], F.array(F.struct(a["slide"].alias("slide"), a["held"].alias("content"))))).otherwise(a["out"])

    return rows.select("document_id", F.explode(F.aggregate("s", start, step, finish)).alias("x")).select("document_id", F.col("x.slide").alias("first_slide"), F.col("x.content").alias("content"))


def sheet_chunks(sheets: DataFrame, most: int = MOST) -> DataFrame:
    """Row groups of a sheet under a repeated header, each within ``most`` tokens.

    ``sheets``: (document_id, name, headers array<string>, rows array<array<string>>).
    """
    rows = sheets.select("document_id", "name", F.posexplode(_sheet(F.struct("name", "headers", "rows"), most)).alias("part", "c"))
    return rows.select("document_id", "name", F.col("part").cast("long").alias("part"), F.col("c.content").alias("content"))


def sheet_parts(sheets: DataFrame, most: int = MOST, slack: int = 20) -> DataFrame:
    """Row groups with ``(part n)`` after the sheet's name and a rule under the header.

    Groups may go over ``most`` by ``slack`` tokens; a first row that repeats the headers is
    no data."""
    same = F.try_element_at("rows", F.lit(1)) == F.col("headers")
    data = F.when(F.coalesce(same, F.lit(False)), F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0)))).otherwise(F.col("rows"))
    parts = sheet_chunks(sheets.withColumn("rows", data), most + slack)
    rule = F.regexp_replace(F.regexp_replace(F.substring_index("content", "\n", 1), "[^|]+", " --- "), "^ --- | --- $", "")
    many = F.count("*").over(Window.partitionBy("document_id", "name")) > 1
    name = F.when(many, F.concat("name", F.lit(" (part "), (F.col("part") + 1).cast("string"), F.lit(")"))).otherwise(F.col("name"))
    body = F.concat(F.substring_index("content", "\n", 1), F.lit("\n"), rule, F.lit("\n"), F.expr("substring(content, instr(content, '\n') + 1)"))
    return parts.select("document_id", name.alias("heading"), "part", body.alias("content"))


def sheet_extras(sheets: DataFrame) -> DataFrame:
    """Charts and named ranges of each sheet as chunks: (document_id, heading, content,
    chunk_type).

    ``sheets`` also has charts array<struct<kind, title, categories, series>> and
    named_ranges array<struct<name, cells>>."""
    chart = lambda c: F.struct(F.concat("name", F.lit(" - "), F.coalesce(c["title"], F.lit("chart"))).alias("heading"), chart_text(c["kind"], c["title"], c["categories"], c["series"]).alias("content"), F.lit("chart").alias("chunk_type"))
    ranges = F.array_join(F.transform("named_ranges", lambda r: F.concat(r["name"], F.lit(": "), r["cells"])), "\n")
    named = F.when(F.size("named_ranges") > 0, F.array(F.struct(F.concat("name", F.lit(" - named ranges")).alias("heading"), ranges.alias("content"), F.lit("text").alias("chunk_type")))).otherwise(F.array())
    return sheets.select("document_id", F.explode(F.concat(F.transform("charts", chart), named)).alias("c")).select("document_id", "c.heading", "c.content", "c.chunk_type")


def sheet_text(sheets: DataFrame, most: int = 50) -> DataFrame:
    """Full text of a workbook: a mark, the headers and the first rows of every sheet."""
    block = F.struct("name", F.concat_ws("\n", F.concat(F.lit("--- Sheet "), F.col("name"), F.lit(" ---")), F.concat_ws(" | ", "headers"), F.array_join(F.transform(F.slice("rows", 1, most), lambda r: F.concat_ws(" | ", r)), "\n")).alias("t"))
    return sheets.groupBy("document_id").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(block)), lambda b: b["t"])).alias("text"))


def merge_small_sections(sections: DataFrame, target: int = TARGET, most: int = MOST) -> DataFrame:
    """Sections as chunks; a leaf under half the target joins the next one of its level.

    ``sections``: (document_id, sections array<struct<heading, level, content>>), flat and
    in document order.  A section is a leaf if the next one is not deeper.  The joined text
    keeps within ``most`` tokens and goes by the first heading.
    """
    one = "struct<heading:string,level:int,content:string>"
    kind = f"struct<out:array<{one}>,held:{one}>"
    start = F.struct(F.array().cast(f"array<{one}>").alias("out"), F.lit(None).cast(one).alias("held")).cast(kind)

    def step(a: Column, s: Column) -> Column:
        held = a["held"]
        text = F.concat(held["content"], F.lit("\n\n"), F.coalesce(s["heading"], F.lit("")), F.lit("\n"), s["content"])
        small = held.isNotNull() & (token_count(held["content"]) < target // 2) & (held["level"] == s["level"]) & (token_count(text) <= most)
        joined = F.struct(a["out"].alias("out"), F.struct(held["heading"].alias("heading"), held["level"].alias("level"), text.alias("content")).alias("held"))
        done = F.when(held.isNotNull(), F.concat(a["out"], F.array(held))).otherwise(a["out"])
        return F.when(small, joined.cast(kind)).otherwise(F.struct(done.alias("out"), s.cast(one).alias("held")).cast(kind))

    finish = lambda a: F.when(a["held"].isNotNull(), F.concat(a["out"], F.array(a["held"]))).otherwise(a["out"])
    out = sections.select("document_id", F.posexplode(F.aggregate("sections", start, step, finish)).alias("sequence_number", "s"))
    return out.where("s.content <> ''").select("document_id", F.col("sequence_number").cast("long"), F.col("s.heading").alias("heading"), F.col("s.content").alias("content"))


def sheet_profile(sheets: DataFrame, show: int = 20) -> DataFrame:
    """Non-empty rows, column names and the first rows of each sheet."""
    full = F.filter("rows", lambda r: F.exists(r, lambda c: c.isNotNull() & (c != "")))
    return sheets.select("document_id", "name", F.size(full).cast("long").alias("rows"), F.concat_ws(",", "headers").alias("columns"), F.concat_ws("\n", F.transform(F.slice(full, 1, show), lambda r: F.concat_ws("|", r))).alias("first"))


def chart_text(kind: Column, title: Column, categories: Column, series: Column) -> Column:
    """A chart in words: at most 20 categories, 5 series, 10 values each."""
    line = lambda s: F.concat(s["name"], F.lit(": "), F.concat_ws(", ", F.transform(F.slice(s["values"], 1, 10), lambda v: v.cast("string"))))
    return F.concat_ws("\n", F.concat(F.lit("["), kind, F.lit("] "), F.coalesce(title, F.lit(""))), F.concat(F.lit("Categories: "), F.concat_ws(", ", F.slice(categories, 1, 20))), F.concat_ws("\n", F.transform(F.slice(series, 1, 5), line)))


def slide_text(slides: DataFrame) -> DataFrame:
    """Full text of a deck: a mark before every slide."""
    block = F.struct("slide", F.concat(F.lit("--- Slide "), F.col("slide").cast("string"), F.lit(" ---\n"), F.concat_ws("\n", "content")).alias("t"))
    return slides.groupBy("document_id").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(block)), lambda b: b["t"])).alias("text"))


def _neighbours(texts: pa.Array, dim: int, place: Callable[[bytes], int]) -> pa.Array:
    """Cosine of each sentence and the next one, by counts of words in ``dim`` places, for
    documents given as lists of lower-cased sentences; ``place`` is that of a word."""
    ends = texts.offsets.to_numpy() - texts.offsets[0].as_py()
    said = texts.flatten().cast(pa.large_binary())
    n = len(said)
    bounds = np.frombuffer(said.buffers()[1], np.int64)[said.offset : said.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(said.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    # words are runs of a to z inside a sentence: where they start, in all bytes and in the letters
    letter = (data >= 97) & (data <= 122)
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    inner = bounds[:-1][bounds[:-1] < len(data)]
    first[inner] = letter[inner]
    starts = np.flatnonzero(first)
    letters = data[letter]
    cuts = np.append(np.flatnonzero(first[letter]), len(letters)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(letters)]).dictionary_encode()
    # each distinct word is hashed once
    places = np.array([place(w) for w in words.dictionary.to_pylist()], np.int64)[words.indices.to_numpy()]
    sentence = np.searchsorted(bounds, starts, "right") - 1
    counts = np.bincount(sentence * dim + places, minlength=n * dim).reshape(-1, dim).astype(float)
    norms = np.sqrt((counts * counts).sum(1))
    dots, bottom = (counts[:-1] * counts[1:]).sum(1), norms[:-1] * norms[1:]
    near, known = np.zeros(n), np.zeros(n, bool)
    known[:-1] = bottom > 0
    near[:-1][known[:-1]] = dots[known[:-1]] / bottom[known[:-1]]
    known[ends[1:][ends[1:] > ends[:-1]] - 1] = False
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(near, mask=~known))


def sentence_pairs(docs: DataFrame, dim: int = 32) -> DataFrame:
    """(document_id, sentence, similarity): each sentence and how like the next one it is,
    by default embeddings (``hooks.hashed_vector``); the last has none.  A document stays in
    its row, and words are counted by Arrow and numpy, a few documents at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = lru_cache(HELD_WORDS)(lambda w: int(hashlib.md5(w).hexdigest()[:4], 16) % dim)
        for batch in batches:
            for k in range(0, batch.num_rows, DOCUMENTS):
                part = batch.slice(k, DOCUMENTS)
                yield pa.RecordBatch.from_arrays([part.column(0), _neighbours(part.column(1), dim, place)], names=["document_id", "near"])

    rows = docs.where("text is not null").select("document_id", F.transform(sentences(F.col("text")), F.lower).alias("_s"))
    kind = StructType([rows.schema["document_id"], StructField("near", ArrayType(DoubleType()))])
    out = rows.mapInArrow(run, kind).select("document_id", F.posexplode("near").alias("sentence", "similarity"))
    return out.select("document_id", F.col("sentence").cast("long").alias("sentence"), F.round("similarity", 6).alias("similarity"))


def topic_boundaries(pairs: DataFrame, threshold: float = 0.75, least: int = 3) -> DataFrame:
    """Segment number of every sentence: a new one after a dissimilar neighbour.

    ``pairs``: (document_id, sentence, similarity to the next).  Documents of fewer than
    ``2 * least`` sentences stay whole, and the first ``least`` stay together.
    """
    whole = Window.partitionBy("document_id")
    cut = (F.col("similarity") < threshold) & (F.col("sentence") + 1 >= least) & (F.count("*").over(whole) >= 2 * least)
    before = whole.orderBy("sentence").rowsBetween(Window.unboundedPreceding, -1)
    rows = pairs.withColumn("_cut", F.coalesce(cut, F.lit(False)).cast("int"))
    return rows.withColumn("segment", F.coalesce(F.sum("_cut").over(before), F.lit(0))).drop("_cut")
