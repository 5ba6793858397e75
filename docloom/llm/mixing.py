"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

A source with ``unit`` of ``total`` weight units gives its block ``j`` the window from
release ``floor(j total / unit)`` to deadline ``ceil((j + 1) total / unit)``, in whole
numbers and without rounding the weights.  Earliest-deadline-first over released blocks
fills every slot and meets every deadline, so after any number of slots each source has
had within one block of its share until a source runs out.  From then on the others keep
their windows; slots for which nothing is released are skipped.  No document is dropped.

Blocks are consecutive documents of a source by ``doc_id``: ``BLOCK_ROWS`` of them, and
at least one of ``SLOTS`` parts of the table, so the schedule has at most ``SLOTS`` plus
the number of sources slots at any size.  It is folded from the weight table (one row)
and joined to the blocks.  Block numbers come from counts per (source, id range), so no
source is gathered in one task however large it is.

The size table and the schedule are written once; both are small.  The fold takes time
in proportion to slots times sources, in one task; there is no limit on either.

Edge cases: a null source is a source of its own; a null ``doc_id`` comes first in its
source; rows with the same id are ordered by the digest of their text; sources with no
given weight, or one under 1, have weight 1; an empty table gives an empty result; very
long texts are only digested; extra columns pass through ``mixed`` and are no inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import n_parts, written

#: Most blocks that the table is cut into, but for what sources leave unfilled.
SLOTS = 1 << 16
BLOCK_ROWS = 16
#: Documents of one source that are ranked together.
RANK_ROWS = 8192

# One step picks, at the first time for which something is released, the released block
# of the earliest deadline; 256 steps are folded at a time, as picks are appended by copy.
_STEP = """
transform(
  array(greatest(st.t, array_min(transform(filter(transform(s, (x, i) -> struct(x, st.had[i] as had)), z -> z.had < z.x.blocks), z -> (z.had * total) div z.x.unit)))),
  t -> transform(
    array(array_min(transform(
      filter(transform(s, (x, i) -> struct(x, st.had[i] as had, i as i)), z -> z.had < z.x.blocks and (z.had * total) div z.x.unit <= t),
      z -> struct(((z.had + 1) * total + z.x.unit - 1) div z.x.unit as deadline, z.i as i))).i),
    p -> if(p is null, st, named_struct(
      'had', transform(st.had, (c, i) -> if(i = p, c + 1, c)),
      't', t + 1,
      'picks', concat(st.picks, array(struct(cast(p as int) as source, st.had[p] as block, t as slot)))))))[0][0]
"""
_NONE = "cast(array() as array<struct<source:int,block:bigint,slot:bigint>>)"
_SCHEDULE = f"""
aggregate(
  sequence(1L, (steps + 255) div 256),
  named_struct('had', transform(s, x -> 0L), 't', 0L, 'parts', cast(array() as array<array<struct<source:int,block:bigint,slot:bigint>>>)),
  (w, k) -> transform(
    array(aggregate(sequence(1, 256), named_struct('had', w.had, 't', w.t, 'picks', {_NONE}), (st, q) -> {_STEP})),
    st -> named_struct('had', st.had, 't', st.t, 'parts', concat(w.parts, array(st.picks))))[0],
  w -> flatten(w.parts))
"""


def size_weights(sizes: DataFrame) -> DataFrame:
    """(source, unit): weights by the square root of the number of documents."""
    return sizes.select("source", F.floor(F.sqrt("n") * 1000).alias("unit"))


def schedule(sources: DataFrame) -> DataFrame:
    """(source, block, slot, release, deadline) of every block of (source, unit, blocks)."""
    row = F.struct(F.col("source").isNull().alias("none"), F.coalesce(F.col("source"), F.lit("")).alias("name"), "unit", "blocks")
    one = sources.groupBy().agg(F.sort_array(F.collect_list(row)).alias("s"), F.sum("unit").alias("total"), F.sum("blocks").alias("steps")).where("steps > 0")
    picked = one.select("s", "total", F.explode(F.expr(_SCHEDULE)).alias("p"))
    own = "s[p.source]"
    return picked.selectExpr(
        f"if({own}.none, null, {own}.name) as source",
        "p.block as block",
        "p.slot as slot",
        f"(p.block * total) div {own}.unit as release",
        f"((p.block + 1) * total + {own}.unit - 1) div {own}.unit as deadline",
    )


def ranked(docs: DataFrame, tie: str = "text") -> tuple[DataFrame, DataFrame]:
    """(``docs`` with ``_mx_rank``, its place in its source from 0; sizes (source, n)).

    Ids are cut at approximate quantiles of their source into ranges of about
    ``RANK_ROWS``; a row's rank is the size of the earlier ranges plus its place in
    its own.
    """
    keyed = docs.withColumn("_mx_id", F.col("doc_id").cast("long")).withColumn("source", F.col("source").cast("string"))
    most = keyed.groupBy("source").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    parts = max(1, -(-most // RANK_ROWS))
    cuts = [i / parts for i in range(1, parts)]
    sizes = keyed.groupBy("source").agg(F.count("*").alias("n"), (F.percentile_approx("_mx_id", cuts, 10 * parts) if cuts else F.array().cast("array<long>")).alias("cuts"))
    sizes = written(sizes, "sizes")
    few = F.when(F.col("n") > RANK_ROWS, F.array_distinct("cuts")).otherwise(F.array().cast("array<long>"))
    bounds = F.broadcast(sizes.select(F.col("source").alias("_mx_s"), few.alias("_mx_cuts")))
    place = F.coalesce(F.size(F.filter("_mx_cuts", lambda c: c < F.col("_mx_id"))), F.lit(0))
    ranged = keyed.join(bounds, keyed["source"].eqNullSafe(bounds["_mx_s"])).withColumn("_mx_range", F.when(F.col("_mx_id").isNull(), 0).otherwise(place)).drop("_mx_s", "_mx_cuts")
    have = ranged.groupBy("source", "_mx_range").agg(F.count("*").alias("c"))
    before = Window.partitionBy("source").orderBy("_mx_range").rowsBetween(Window.unboundedPreceding, -1)
    have = have.select(F.col("source").alias("_mx_s"), F.col("_mx_range").alias("_mx_r"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("_mx_before"))
    own = Window.partitionBy("source", "_mx_range").orderBy(F.col("_mx_id").asc_nulls_first(), F.md5(F.coalesce(F.col(tie).cast("string"), F.lit(""))))
    out = ranged.withColumn("_mx_place", F.row_number().over(own) - 1)
    out = out.join(F.broadcast(have), out["source"].eqNullSafe(have["_mx_s"]) & (out["_mx_range"] == have["_mx_r"]))
    return out.withColumn("_mx_rank", (F.col("_mx_before") + F.col("_mx_place")).cast("long")).drop("_mx_s", "_mx_r", "_mx_before", "_mx_place", "_mx_range", "_mx_id"), sizes.select("source", "n")


def _mixed(docs: DataFrame, weights: DataFrame | None, block_rows: int, slots: int) -> DataFrame:
    # a row's own columns go along as one, so none of them can be taken for one made here
    rows, sizes = ranked(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_mx_doc"), "doc_id", "source", "text"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    block_rows = max(block_rows, -(-total // slots))
    if weights is not None:
        given = weights.select(F.col("source").alias("_mx_s"), F.col("unit").cast("long"))
        units = sizes.join(F.broadcast(given), sizes["source"].eqNullSafe(given["_mx_s"]), "left").select("source", "unit", "n")
    else:
        units = sizes.join(size_weights(sizes).select(F.col("source").alias("_mx_s"), "unit"), F.col("source").eqNullSafe(F.col("_mx_s"))).select("source", "unit", "n")
    units = units.select("source", F.greatest(F.lit(1).cast("long"), F.coalesce("unit", F.lit(1))).alias("unit"), F.expr(f"(n + {block_rows - 1}) div {block_rows}L").alias("blocks"))
    plan = written(schedule(units), "schedule").select(F.col("source").alias("_mx_s"), F.col("block").alias("_mx_b"), F.col("slot").alias("_mx_at"), F.col("release").alias("_mx_release"), F.col("deadline").alias("_mx_deadline"))
    rows = rows.withColumn("_mx_block", F.expr(f"_mx_rank div {block_rows}L")).withColumn("_mx_place", F.expr(f"_mx_rank % {block_rows}L"))
    return rows.join(F.broadcast(plan), rows["source"].eqNullSafe(plan["_mx_s"]) & (rows["_mx_block"] == plan["_mx_b"]))


def mixed(docs: DataFrame, weights: DataFrame | None = None, block_rows: int = BLOCK_ROWS, slots: int = SLOTS) -> DataFrame:
    """``docs`` with ``block``, ``place``, ``slot``, ``release`` and ``deadline``, which
    replace columns of those names.

    ``weights`` has (source, unit), one row a source; by default they follow
    ``size_weights``.  Order by (slot, place) to read the mixture.
    """
    added = {"block": "_mx_block", "place": "_mx_place", "slot": "_mx_at", "release": "_mx_release", "deadline": "_mx_deadline"}
    docs = docs.withColumn("source", F.col("source").cast("string"))
    own = [c for c in docs.columns if c.lower() not in added]
    return _mixed(docs, weights, block_rows, slots).select(*[F.col("_mx_doc").getField(c).alias(c) for c in own], *[F.col(c).alias(n) for n, c in added.items()])


def in_order(docs: DataFrame, weights: DataFrame | None = None, block_rows: int = BLOCK_ROWS, slots: int = SLOTS) -> DataFrame:
    """The rows of ``docs`` sorted by their place in the mixture: written as files,
    these hold it in the order of their names."""
    order = [F.col("_mx_at"), F.col("_mx_place")]
    parts = n_parts(docs.sparkSession)
    out = _mixed(docs, weights, block_rows, slots)
    return out.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*[F.col("_mx_doc").getField(c).alias(c) for c in docs.columns])
