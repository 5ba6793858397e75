"""Document-entity graph as vertex and edge tables.

Relations between documents are kept once with the smaller id first and are read in
both directions.  What a user looks up or is led to is held against the access table
unless a caller says ``enforce_acl=False``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from docloom.functions.text import edge_weight
from docloom.operators.search import visible
from docloom.sources.scratch import kept, scratch_path

#: Documents of one item that one task pairs with as many others.
CHUNK = 2000
#: Tasks that pairs are dealt to at most; one makes about ``CHUNK`` squared of them.
MOST_TASKS = 20_000
#: Chunks that an item is cut into at most.  A chunk is sent to every other one, so without
#: this bound what is sent grew with the square of the documents.
MOST_CHUNKS = 64
TRAVERSED = ["CITES", "RELATED_TO", "SHARES_ENTITY", "SUPERSEDES"]


def next_chunk_edges(chunks: DataFrame) -> DataFrame:
    """NEXT_CHUNK: each chunk to the following one of its document."""
    order = Window.partitionBy("document_id").orderBy("sequence_number", "chunk_id")
    out = chunks.select(F.col("chunk_id").alias("src"), F.lead("chunk_id").over(order).alias("dst"))
    return out.where("dst is not null").withColumn("type", F.lit("NEXT_CHUNK"))


def graph_index(chunks: DataFrame) -> DataFrame:
    """Chunk index from 0 inside each document."""
    order = Window.partitionBy("document_id").orderBy("sequence_number", "chunk_id")
    return chunks.select("document_id", "chunk_id", (F.row_number().over(order) - 1).cast("long").alias("index"))


def contains_edges(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("document_id").alias("src"), F.col("chunk_id").alias("dst"), F.lit("CONTAINS").alias("type"))


def belongs_edges(chunks: DataFrame) -> DataFrame:
    return chunks.where("department is not null").select(F.col("document_id").alias("src"), F.col("department").alias("dst"), F.lit("BELONGS_TO").alias("type")).distinct()


def merge_entities(mentions: DataFrame) -> DataFrame:
    """Entities of a document under lower(name), type: counts added, first name kept;
    where ``mentions`` has them, chunk ids and sections are united, and other names are
    aliases."""
    key = F.lower(F.trim("name")).alias("key")
    united = [F.array_sort(F.collect_set(c)).alias(a) for c, a in (("chunk_id", "chunk_ids"), ("heading", "sections")) if c in mentions.columns]
    out = mentions.groupBy("document_id", key, "type").agg(F.sum("n").alias("n"), F.min(F.struct("first_at", "name")).alias("f"), F.collect_set("name").alias("names"), *united)
    return out.withColumn("name", F.col("f.name")).withColumn("aliases", F.array_sort(F.array_except("names", F.array("name")))).drop("f", "names")


def document_vertices(documents: DataFrame, keep: list[str]) -> DataFrame:
    """One vertex per document with the columns ``keep``; of repeated rows the last by
    ``modified_at``, then by its columns, stays."""
    last = Window.partitionBy("document_id").orderBy(F.desc_nulls_last("modified_at"), *keep)
    return documents.select("document_id", "modified_at", *keep).withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def chunk_vertices(chunks: DataFrame, most: int = 200) -> DataFrame:
    """One vertex per chunk: its document, index, heading and the start of its text."""
    own = graph_index(chunks).select(F.col("chunk_id").alias("_c"), "index")
    return chunks.join(own, F.col("chunk_id") == F.col("_c")).select("chunk_id", "document_id", "index", "heading", F.substring("content", 1, most).alias("summary"))


def entity_vertices(mentions: DataFrame) -> DataFrame:
    """One vertex per (lower name, type): name, aliases and time of the mention that has
    created it; later ones add no alias.  ``mentions`` without aliases give none."""
    key = F.lower(F.trim("name")).alias("key")
    aliases = F.col("aliases") if "aliases" in mentions.columns else F.array().cast("array<string>")
    out = mentions.select(key, "type", F.struct("first_at", "name", aliases.alias("aliases")).alias("f")).groupBy("key", "type").agg(F.min("f").alias("f"))
    return out.select("key", "type", F.col("f.name").alias("name"), F.col("f.first_at").alias("first_at"), F.array_sort(F.coalesce("f.aliases", F.array().cast("array<string>"))).alias("aliases"))


def mentioned_edges(mentions: DataFrame) -> DataFrame:
    """MENTIONED_IN: entity to document, with how often and, where ``mentions`` has
    headings, in which sections."""
    sections = [F.array_sort(F.collect_set("heading")).alias("sections")] if "heading" in mentions.columns else []
    return mentions.groupBy("name", "type", "document_id").agg(F.sum("n").alias("count"), *sections)


def mentions_in_chunks(mentions: DataFrame) -> DataFrame:
    """MENTIONED_IN_CHUNK: entity to chunk, with how often and in which sections.

    ``mentions`` has (name, type, chunk_id, heading, n)."""
    out = mentions.where("chunk_id is not null").groupBy(F.lower(F.trim("name")).alias("key"), "type", "chunk_id")
    return out.agg(F.sum("n").alias("count"), F.array_sort(F.collect_set("heading")).alias("sections"))


def topic_edges(topics: DataFrame, relevance: float = 0.7) -> DataFrame:
    return topics.select(F.col("document_id").alias("src"), F.col("topic").alias("dst"), F.lit("COVERED_IN").alias("type"), F.lit(relevance).alias("relevance")).distinct()


def topic_vertices(topics: DataFrame) -> DataFrame:
    """One vertex per topic; its department, null or not, is that of the document written
    last (``document_id`` where there is no ``written_at``)."""
    order = "written_at" if "written_at" in topics.columns else "document_id"
    return topics.groupBy("topic").agg(F.max_by("department", order).alias("department"))


def _distinct_items(pairs: DataFrame, item: str) -> DataFrame:
    return pairs.select("document_id", F.col(item).alias("item")).where("document_id is not null and item is not null").distinct()


def _tasks(pairs: int, chunk: int) -> int:
    return max(1, min(MOST_TASKS, -(-pairs // chunk**2)))


def _chunks(n: str, chunk: int) -> Column:
    return F.least(F.ceil(F.col(n) / chunk), F.lit(MOST_CHUNKS)).cast("int")


def _packed(rows: DataFrame, chunks: str, *more: str) -> DataFrame:
    """``rows`` with one row a chunk of an item, numbered ``own``: its ``docs`` in order, which
    are structs with ``more`` columns only."""
    own = F.pmod(F.xxhash64("document_id"), F.col(chunks)).cast("int").alias("own")
    by = [c for c in rows.columns if c not in ("document_id", *more)]
    return rows.groupBy(*by, own).agg(F.sort_array(F.collect_list(F.struct("document_id", *more) if more else "document_id")).alias("docs"))


def _cells(a: DataFrame, b: DataFrame, tasks: int, *more: str) -> DataFrame:
    """(i, j, x, y, item, ...): all pairs of ``docs_0`` and ``docs_1`` of the chunks that meet
    in a cell (item, i, j).  Chunks are sent, pairs are made of them in the task.

    The number of tasks is given, since Spark would choose it by the bytes read, which are
    few, and not by the pairs made of them; what fits one task is left to Spark."""
    # one key of one type, or a constant item is no key of the join and all is shuffled again
    cell = F.struct(*[F.when(F.col(c).isNotNull(), F.col(c)).alias(c) for c in ("item", "i", "j")]).alias("cell")
    a, b = a.select(cell, "docs_0"), b.select(cell, "docs_1")
    if tasks > 1:
        a, b = a.repartition(tasks, "cell"), b.repartition(tasks, "cell")
    # Spark holds all rows that one row is made into: one side is unpacked before the join,
    # and the other is the one that is looked up in it
    met = a.select("cell", F.explode("docs_0").alias("_0")).join(b.hint("shuffle_hash"), "cell").select("cell.*", "_0", F.explode("docs_1").alias("_1"))
    x, y = (F.col(f"_{k}.document_id" if more else f"_{k}") for k in (0, 1))
    return met.select("i", "j", x.alias("x"), y.alias("y"), "item", *[F.col(f"_{k}.{c}").alias(f"{c}_{k}") for c in more for k in (0, 1)])


def _met(rows: DataFrame, chunk: int, *more: str) -> DataFrame:
    """(x, y, item): two documents with an item in common, each pair of them once an item;
    of columns ``more``, ``c_0`` and ``c_1`` of the two.

    ``rows`` has (document_id, item, _n), ``_n`` being the documents of the item in
    ``rows``.  They are cut into chunks of about ``chunk``, and every two chunks meet in one
    task, so an item of a third of all documents is many tasks.  An item has at most
    ``MOST_CHUNKS`` of them, so a document is sent at most as often, and one time more."""
    tasks = _tasks((rows.agg(F.sum("_n")).first()[0] or 0) // 2, chunk)
    rows = _packed(rows.select("item", _chunks("_n", chunk).alias("_k"), "document_id", *more), "_k", *more)
    a = rows.select("item", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("_k") - 1)).alias("j"), F.col("docs").alias("docs_0"))
    b = rows.select("item", F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"), F.col("docs").alias("docs_1"))
    out = _cells(a, b, tasks, *more).where("i < j or x < y").withColumns({"x": F.least("x", "y"), "y": F.greatest("x", "y")})
    return out.drop("i", "j")


def _met_with(asked: DataFrame, known: DataFrame, chunk: int, *more: str) -> DataFrame:
    """As ``_met`` with x of ``asked`` and another y of ``known``, both distinct
    (document_id, item).  Both sides of an item are cut into chunks."""
    size = asked.groupBy("item").agg(F.count("*").alias("_a")).join(known.groupBy("item").agg(F.count("*").alias("_b")), "item")
    tasks = _tasks(size.agg(F.sum(F.col("_a") * F.col("_b"))).first()[0] or 0, chunk)
    size = size.select("item", *[_chunks(n, chunk).alias(n) for n in ("_a", "_b")])
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = _packed(asked.join(size, "item"), "_a", *more).select("item", F.col("own").alias("i"), each("_b").alias("j"), F.col("docs").alias("docs_0"))
    b = _packed(known.join(size, "item"), "_b", *more).select("item", each("_a").alias("i"), F.col("own").alias("j"), F.col("docs").alias("docs_1"))
    return _cells(a, b, tasks, *more).where("x <> y").drop("i", "j")


def _of_one_item(rows: DataFrame) -> bool:
    """Whether no document has two items."""
    return (rows.groupBy("document_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) <= 1


def _with_items(rows: DataFrame) -> DataFrame:
    """``rows`` with ``items``, all items of the row's document."""
    return rows.withColumn("items", F.collect_set("item").over(Window.partitionBy("document_id")))


def _once(met: DataFrame) -> DataFrame:
    """(a, b, n, names) of documents that met with their items, each pair at the first item
    that both have: no pair is shuffled to be counted."""
    both = met.withColumn("names", F.array_sort(F.array_intersect("items_0", "items_1"))).where(F.col("item") == F.get("names", F.lit(0)))
    return both.select(F.col("x").alias("a"), F.col("y").alias("b"), F.size("names").cast("long").alias("n"), "names")


def _of_item(met: DataFrame) -> DataFrame:
    """The same of documents that have no second item in common."""
    return met.select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit(1).cast("long").alias("n"), F.array("item").alias("names"))


def _with_size(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_n``, the number of documents that have the item."""
    size = rows.groupBy("item").agg(F.count("*").alias("_n")).withColumnRenamed("item", "_item")
    return rows.join(size, F.col("item") == F.col("_item")).drop("_item")


def prefixes(rows: DataFrame, least: int) -> DataFrame:
    """(document_id, item): each document's items but its ``least - 1`` most common ones.

    Items are ordered by how many documents have them (``_n``), then by themselves.  Two
    documents with ``least`` items in common have one of them in both prefixes: the first
    common one has ``least - 1`` further ones behind it in either."""
    own = Window.partitionBy("document_id")
    placed = rows.withColumn("_at", F.row_number().over(own.orderBy("_n", "item"))).withColumn("_of", F.count("*").over(own))
    return placed.where(F.col("_at") <= F.col("_of") - least + 1).select("document_id", "item")


def candidates(pairs: DataFrame, item: str, least: int, chunk: int = CHUNK) -> DataFrame:
    """(x, y): document pairs that share an item of their prefixes, and so may have
    ``least`` items in common."""
    return _met(_with_size(prefixes(_with_size(_distinct_items(pairs, item)), least)), chunk).select("x", "y").distinct()


def _item_sets(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy(F.col("document_id").alias(name)).agg(F.collect_set("item").alias(f"items_{name}"))


def _verified(found: DataFrame, x: DataFrame, y: DataFrame, least: int) -> DataFrame:
    """(a, b, n, names) of the pairs whose sets (x, items_x) and (y, items_y) have ``least``
    items in common."""
    both = found.join(x, "x").join(y, "y").withColumn("names", F.array_sort(F.array_intersect("items_x", "items_y")))
    out = both.select(F.col("x").alias("a"), F.col("y").alias("b"), F.size("names").cast("long").alias("n"), "names")
    return out.where(F.col("n") >= least)


def shared(pairs: DataFrame, item: str, least: int, most_documents: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """(a, b, n, names): document pairs a < b with at least ``least`` common items.

    ``pairs`` is (document_id, item...).  From ``least`` 2 on only pairs that share an item
    of their prefixes meet, and are verified on their whole sets, so the pairs of a common
    item are never made.  With ``least`` 1 an item in d documents makes d * d / 2 pairs,
    which are the result (``shared_with`` gives those of chosen documents only).
    ``most_documents`` leaves out more common items and is off by default.
    """
    rows = _distinct_items(pairs, item)
    if most_documents is not None:
        rows = _with_size(rows).where(F.col("_n") <= most_documents).drop("_n")
    if least > 1:
        return _verified(candidates(rows, "item", least, chunk), _item_sets(rows, "x"), _item_sets(rows, "y"), least)
    if _of_one_item(rows):
        return _of_item(_met(_with_size(rows), chunk))
    return _once(_met(_with_size(_with_items(rows)), chunk, "items"))


def shared_with(wanted: DataFrame, rows: DataFrame, least: int, chunk: int = CHUNK) -> DataFrame:
    """(a, b, n, names) with ``a`` among the wanted documents and any ``b`` in ``rows``.

    ``wanted`` and ``rows`` are distinct (document_id, item); of ``rows`` only those of
    wanted items are used.  Wanted documents look for partners by their prefixes; with
    ``least`` 1 all that meet are the result."""
    known = rows.join(wanted.select("item").distinct(), "item", "left_semi")
    if least <= 1:
        if _of_one_item(wanted):
            return _of_item(_met_with(wanted, known, chunk))
        return _once(_met_with(_with_items(wanted), _with_items(known), chunk, "items"))
    size = known.groupBy("item").agg(F.count("*").alias("_n"))
    asked = prefixes(wanted.join(size, "item", "left").fillna(0, ["_n"]), least)
    found = _met_with(asked, known, chunk).select("x", "y").distinct()
    partners = known.join(found.select(F.col("y").alias("document_id")).distinct(), "document_id", "left_semi")
    return _verified(found, _item_sets(wanted, "x"), _item_sets(partners, "y"), least)


def superseding(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """Newer versions of the given documents."""
    e = edges.where("type = 'SUPERSEDES' and dst is not null").select(F.col("src").alias("document_id"), F.col("dst").alias("newer"))
    return e.join(ids.select("document_id").distinct(), "document_id")


def entity_lookup(mentions: DataFrame, wanted: DataFrame, access: DataFrame | None = None, most: int = 10, enforce_acl: bool = True) -> DataFrame:
    """Documents that mention wanted (user_id, name, type), most mentions first."""
    hit = mentions.groupBy("name", "type", "document_id").agg(F.sum("n").alias("n")).join(wanted.distinct(), ["name", "type"])
    hit = visible(hit, access, enforce_acl)
    order = Window.partitionBy("user_id", "name", "type").orderBy(F.desc("n"), "document_id")
    return hit.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def document_context(ids: DataFrame, mentions: DataFrame, topics: DataFrame, edges: DataFrame, access: DataFrame | None = None, enforce_acl: bool = True) -> DataFrame:
    """Entities, topics and citations of the documents that (user_id, document_id) may see;
    each side is aggregated first."""
    want = visible(ids.select("user_id", "document_id").distinct(), access, enforce_acl)
    e = mentions.groupBy("document_id").agg(F.array_sort(F.collect_set("name")).alias("entities"))
    t = topics.groupBy("document_id").agg(F.array_sort(F.collect_set("topic")).alias("topics"))
    c = edges.where("type = 'CITES'").groupBy(F.col("src").alias("document_id")).agg(F.array_sort(F.collect_set("dst")).alias("cites"))
    return want.join(e, "document_id", "left").join(t, "document_id", "left").join(c, "document_id", "left")


def both_ways(edges: DataFrame) -> DataFrame:
    cols = ["type", "count", "strength"]
    e = edges.where(F.col("type").isin(TRAVERSED) & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    return e.select("src", "dst", *cols).unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *cols))


def _may_pass(rows: DataFrame, levels: DataFrame | None, access_levels: list[str] | None) -> DataFrame:
    """Rows whose document has one of the access levels, or none; ``levels`` has
    (document_id, access_level)."""
    if levels is None or access_levels is None:
        return rows
    shut = levels.where(F.col("access_level").isNotNull() & ~F.col("access_level").isin(access_levels)).select("document_id").distinct()
    return rows.join(shut, "document_id", "left_anti")


def expand(seeds: DataFrame, edges: DataFrame, access: DataFrame | None = None, limit: int = 5, per_seed: int = 20, enforce_acl: bool = True, levels: DataFrame | None = None, access_levels: list[str] | None = None) -> DataFrame:
    """Related documents of each query's seeds (query_id, user_id, document_id):
    (query_id, document_id, types, weight, rank).

    Neighbours in either direction that the query's user may see; the best ``per_seed``
    of each seed; rolled up per related document with its relation types and largest
    weight; the best ``limit``.
    """
    e = both_ways(edges).withColumn("weight", F.round(edge_weight(F.col("type"), F.coalesce("count", F.lit(0)), F.col("strength")), 6))
    near = seeds.select("query_id", "user_id", F.col("document_id").alias("src")).distinct().join(e, "src").withColumnRenamed("dst", "document_id")
    near = _may_pass(visible(near, access, enforce_acl), levels, access_levels)
    order = Window.partitionBy("query_id", "src").orderBy(F.desc("weight"), "document_id", "type")
    near = near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_seed)
    rolled = near.groupBy("query_id", "document_id").agg(F.array_sort(F.collect_set("type")).alias("types"), F.max("weight").alias("weight"))
    rolled = rolled.join(seeds.select("query_id", "document_id").distinct(), ["query_id", "document_id"], "left_anti")
    best = Window.partitionBy("query_id").orderBy(F.desc("weight"), "document_id")
    return rolled.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)


def expand_hops(seeds: DataFrame, edges: DataFrame, access: DataFrame | None = None, hops: int = 2, enforce_acl: bool = True) -> DataFrame:
    """(query_id, document_id, hop): documents within ``hops`` steps of the seeds
    (query_id, user_id, document_id); documents that a query's user may not see are no steps.

    Breadth first: a hop joins the last frontier with the edges and leaves out what was
    reached before.  Edges and every frontier are written, so each hop's plan is the same
    size, and a hop without new documents is the last."""
    spark = seeds.sparkSession
    e = kept(both_ways(edges).select("src", "dst").distinct(), "links")
    base = scratch_path(spark, "hops")
    hop = lambda h: f"{base}/hop={h}"
    rows = seeds.select("query_id", "user_id", "document_id").where("document_id is not null").distinct()
    rows.write.parquet(hop(0))
    for h in range(1, hops + 1):
        front = spark.read.schema(rows.schema).parquet(hop(h - 1))
        seen = spark.read.schema(rows.schema).parquet(*[hop(k) for k in range(h)])
        found = Observation()
        hop_step(front, seen, e, access, enforce_acl).observe(found, F.count("*").alias("n")).write.parquet(hop(h))
        if not found.get["n"]:
            break
    out = spark.read.schema(StructType([*rows.schema.fields, StructField("hop", IntegerType())])).parquet(base)
    return out.where("hop > 0").select("query_id", "document_id", "hop")


def hop_step(front: DataFrame, seen: DataFrame, links: DataFrame, access: DataFrame | None, enforce_acl: bool = True) -> DataFrame:
    """(query_id, user_id, document_id) one step from ``front`` that are not in ``seen``."""
    step = front.join(links, front["document_id"] == links["src"]).select("query_id", "user_id", F.col("dst").alias("document_id")).distinct()
    old = seen.select(F.col("query_id").alias("_q"), F.col("user_id").alias("_u"), F.col("document_id").alias("_d"))
    same = F.col("query_id").eqNullSafe(F.col("_q")) & F.col("user_id").eqNullSafe(F.col("_u")) & (F.col("document_id") == F.col("_d"))
    return visible(step, access, enforce_acl).join(old, same, "left_anti").select("query_id", "user_id", "document_id")


def delete_from_graph(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without either end among the deleted documents."""
    g = gone.select(F.col("document_id").alias("_gone")).distinct()
    return edges.join(g, F.col("src") == F.col("_gone"), "left_anti").join(g, F.col("dst") == F.col("_gone"), "left_anti")


def merge_vertices(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Idempotent merge of vertices or, with key (src, dst, type), of edges: the last row
    by ``order`` of each key wins, ties by the other columns."""
    last = Window.partitionBy(*key).orderBy(F.desc(order), *[F.col(c) for c in old.columns if c not in (*key, order)])
    return old.unionByName(new).withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
