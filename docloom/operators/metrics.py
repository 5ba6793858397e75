"""Service metrics over windows, alerts, chart series and sheet totals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import TOKEN


def rates(events: DataFrame, key: str, width: str = "5 minutes", seconds: int = 300) -> DataFrame:
    """Events per second by key and tumbling window."""
    w = F.window("seen_at", width)
    return events.groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n", F.round(F.col("n") / seconds, 6).alias("rate"))


def ratio(events: DataFrame, test: Column, width: str = "10 minutes") -> DataFrame:
    """Share of events that pass a test, by tumbling window."""
    return events.groupBy(F.window("seen_at", width).alias("w")).agg(F.round(F.avg(test.cast("int")), 6).alias("ratio"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "ratio", "n")


def latency_quantiles(events: DataFrame, width: str = "5 minutes") -> DataFrame:
    """Exact p50, p95 and p99 by window."""
    q = lambda p: F.round(F.percentile("latency", F.lit(p)), 6)
    return events.groupBy(F.window("seen_at", width).alias("w")).agg(q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99")).select(F.col("w.start").alias("start"), "p50", "p95", "p99")


#: Size of the quantile sketches, and by how much the rank of one of their quantiles may be
#: off, with 99 % confidence, as the sketch's authors give it for this size.
SKETCH, RANK_ERROR = 400, 0.0068


def latency_sketch(events: DataFrame, width: str = "5 minutes", size: int = SKETCH) -> DataFrame:
    """(start, sketch, n): mergeable quantile sketches by window, for tables too large for
    exact ones; a window is a few kilobytes whatever its number of events."""
    return events.groupBy(F.window("seen_at", width).alias("w")).agg(F.kll_sketch_agg_double("latency", size).alias("sketch"), F.count("latency").alias("n")).select(F.col("w.start").alias("start"), "sketch", "n")


def rolled_up(sketches: DataFrame, width: str) -> DataFrame:
    """Sketches of longer windows from those of shorter ones, without their events."""
    out = sketches.groupBy(F.window("start", width).alias("w")).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))
    return out.select(F.col("w.start").alias("start"), "sketch", "n")


def sketched_quantiles(sketches: DataFrame, at: dict[str, float]) -> DataFrame:
    """(start, n, one column a quantile), e.g. {"p95": 0.95}; null where there is no event."""
    quantile = lambda q: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(q)))
    return sketches.select("start", "n", *[quantile(q).alias(name) for name, q in at.items()])


def sliding_rates(events: DataFrame, width: str = "5 minutes", step: str = "1 minute") -> DataFrame:
    return events.groupBy(F.window("seen_at", width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def held_alerts(points: DataFrame, key: str, order: str, test: Column, least: int) -> DataFrame:
    """Islands of at least ``least`` consecutive points that pass: (key, first, last, n)."""
    every = Window.partitionBy(key).orderBy(order)
    rows = points.withColumn("_all", F.row_number().over(every)).where(test)
    rows = rows.withColumn("_island", F.col("_all") - F.row_number().over(every))
    out = rows.groupBy(key, "_island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))
    return out.where(F.col("n") >= least).drop("_island")


def held_for(points: DataFrame, key: str, at: str, test: Column, span: str, gap: str) -> DataFrame:
    """Alerts that hold for a span of time: (key, first, last, fired_at, n).

    An island is passing points with no failing point between them and no two further
    apart than ``gap`` (without points a condition is not known to hold).  It fires at its
    first point that is at least ``span`` after its first, however many there are."""
    order = Window.partitionBy(key).orderBy(at, F.when(test, 1).otherwise(0))
    passed = F.coalesce(test, F.lit(False))
    before, before_at = F.lag(passed).over(order), F.lag(at).over(order)
    starts = passed & ~(F.coalesce(before, F.lit(False)) & (F.col(at) <= before_at + F.expr(f"interval {gap}")))
    rows = points.withColumns({"_ok": passed, "_new": starts}).withColumn("_island", F.sum(F.col("_new").cast("int")).over(order)).where("_ok")
    rows = rows.withColumn("_from", F.min(at).over(Window.partitionBy(key, "_island")))
    late = F.col(at) >= F.col("_from") + F.expr(f"interval {span}")
    out = rows.groupBy(key, "_island").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.min(F.when(late, F.col(at))).alias("fired_at"), F.count("*").alias("n"))
    return out.where("fired_at is not null").drop("_island")


def held_sessions(points: DataFrame, key: str, at: str, test: Column, span: str, gap: str) -> DataFrame:
    """The same for a stream of evenly spaced points, as session windows: (key, first,
    last, n).  A failing point leaves a hole, so ``gap`` is under two intervals; an island
    comes out once the watermark has passed its end."""
    out = points.where(test).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))
    return out.where(F.col("last") >= F.col("first") + F.expr(f"interval {span}")).select(key, "first", "last", "n")


def share_of_total(rows: DataFrame, value: str, partition: list[str]) -> DataFrame:
    """Each row's share, and the total, of its partition."""
    total = F.sum(value).over(Window.partitionBy(*partition))
    return rows.withColumn("total", F.round(total, 2)).withColumn("share", F.round(F.col(value) / total, 6))


def waterfall(rows: DataFrame, order: str, value: str, partition: list[str]) -> DataFrame:
    """Base of each bar: 0 for the first and the last, else the sum before it."""
    w = Window.partitionBy(*partition).orderBy(order)
    first, last = F.row_number().over(w) == 1, F.lead(value).over(w).isNull()
    before = F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return rows.withColumn("base", F.round(F.when(first | last, 0.0).otherwise(before), 2))


def matrix(rows: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """Heat-map matrix: one column for each named label."""
    return rows.groupBy(row).pivot(column, columns).agg(F.round(F.sum(value), 2))


def box_statistics(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Quartiles and fences at 1.5 times the quartile distance."""
    q = rows.groupBy(key).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    reach = 1.5 * (F.col("q")[2] - F.col("q")[0])
    return q.select(key, *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q1", "median", "q3"))], F.round(F.col("q")[0] - reach, 6).alias("low"), F.round(F.col("q")[2] + reach, 6).alias("high"))


def column_totals(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Totals of columns of text; what is no number counts as nothing."""
    return rows.agg(*[F.round(F.sum(F.expr(f"try_cast({c} as double)")), 2).alias(c) for c in columns])


def compare_methods(chunks: DataFrame, methods: list[str]) -> DataFrame:
    """Chunks of each extraction method, and their tokens, side by side per document."""
    return chunks.groupBy("document_id").pivot("extraction_method", methods).agg(F.count(F.lit(1)).alias("chunks"), F.sum("token_count").alias("tokens"), F.count_distinct("content_type").alias("types"))


def map_reduce(text: Column, part: Callable[[Column], Column], single: Callable[[Column], Column], reduce: Callable[[Column], Column], window: int = 4000, most: int = 8000) -> Column:
    """A text of at most ``most`` tokens through ``single``; a longer one in windows of
    ``window`` tokens through ``part``, joined in order under ``Section i:`` labels and
    passed through ``reduce``.  A document stays in its row."""
    tokens = F.regexp_extract_all(text, F.lit(f"(?:{TOKEN})\\s*"), F.lit(0))
    starts = F.sequence(F.lit(1), F.size(tokens), F.lit(window))
    line = lambda at, i: F.concat(F.lit("Section "), (i + 1).cast("string"), F.lit(": "), part(F.array_join(F.slice(tokens, at, window), "")))
    return F.when(F.size(tokens) <= most, single(text)).otherwise(reduce(F.array_join(F.transform(starts, line), "\n\n")))


def lead_sentence(text: Column) -> Column:
    """Default map step: text up to the first full stop."""
    return F.substring_index(text, ".", 1)
