"""Vector search over chunks for many queries at once, and what follows it.

Access is checked unless a caller says ``enforce_acl=False``.  Scores are compared rounded to six places, ties go to the smaller chunk id, so a
ranking is the same whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from docloom.sources.scratch import scratch_path

#: Queries that are sent to all tasks at once; more are searched in blocks.
QUERY_BLOCK = 4096
#: Scores that a task holds at once.
CELLS = 1 << 19


def _by_score() -> list[Column]:
    return [F.desc("score"), F.asc("chunk_id")]


def metadata_filter(department: str | None = None, content_type: str | None = None, extraction_method: str | None = None, created_from=None, created_to=None, access_levels: list[str] | None = None) -> Column:
    """Conjunction of the given predicates; what is not given does not restrict.

    ``access_levels`` lets rows without a level pass."""
    out = F.lit(True)
    for name, value in (("department", department), ("content_type", content_type), ("extraction_method", extraction_method)):
        if value is not None:
            out &= F.col(name) == value
    if created_from is not None:
        out &= F.col("created_at") >= F.lit(created_from)
    if created_to is not None:
        out &= F.col("created_at") <= F.lit(created_to)
    if access_levels is not None:
        out &= F.col("access_level").isin(access_levels) | F.col("access_level").isNull()
    return out


def completed_only(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks whose document is completed (semi join on the status table)."""
    done = documents.where("status = 'completed'").select("document_id")
    return chunks.join(done, "document_id", "left_semi")


def in_documents(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    return chunks.join(ids.select("document_id").distinct(), "document_id", "left_semi")


def query_blocks(queries: DataFrame, most: int = QUERY_BLOCK) -> Iterator[DataFrame]:
    """The queries in parts of about ``most`` rows, by hash of their id."""
    n = -(-queries.count() // most)
    if n <= 1:
        yield queries
    else:
        for k in range(n):
            yield queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == k)


def visible(rows: DataFrame, access: DataFrame | None, enforce_acl: bool = True) -> DataFrame:
    """The rows (user_id, document_id, ...) whose user may see the document."""
    if not enforce_acl:
        return rows
    if access is None:
        raise ValueError("an access table is required; enforce_acl=False searches without one")
    return rows.join(access.select("user_id", "document_id").distinct(), ["user_id", "document_id"], "left_semi")


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """[row, component], with NaN rows for vectors that cannot be compared."""
    out = np.full((len(column), dim), np.nan)
    many = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    own = np.flatnonzero(many == dim)
    if len(own):
        out[own] = pc.fill_null(column.take(pa.array(own)).flatten(), np.nan).to_numpy(zero_copy_only=False).reshape(-1, dim)
    return out


class Block:
    """A block of queries as arrays, for tasks: vectors, their lengths, ids and users."""

    def __init__(self, block: DataFrame):
        q = block.select("query_id", "user_id", "embedding", "department").orderBy("query_id").toArrow()
        self.ids, self.users = q.column("query_id").to_pylist(), q.column("user_id").to_pylist()
        vectors = q.column("embedding").combine_chunks()
        self.dim = max(pc.list_value_length(vectors).to_pylist() or [0], key=lambda n: n or 0) or 1
        self.vectors = _vectors(vectors, self.dim)
        self.departments = np.array([d or "" for d in q.column("department").to_pylist()], object)

    def arrays(self) -> tuple:
        return self.vectors, np.sqrt((self.vectors * self.vectors).sum(1)), self.dim, self.departments

    def allowed(self, chunks: DataFrame, access: DataFrame) -> DataFrame:
        """``chunks`` with ``_may``: numbers of the block's queries that may see each."""
        asked = chunks.sparkSession.createDataFrame([(u, k) for k, u in enumerate(self.users) if u is not None], "user_id long, _q int")
        may = access.select("user_id", "document_id").distinct().join(F.broadcast(asked), "user_id").groupBy("document_id").agg(F.collect_list("_q").alias("_may"))
        return chunks.join(may, "document_id")


def _cosines(batch: pa.RecordBatch, block: tuple, match_department: bool) -> np.ndarray:
    """[row, query] cosine to six places; NaN where the pair may not be seen.

    ``_may`` and ``_asked``, where there, hold the numbers of a row's queries."""
    m, norms, dim, departments = block
    column = lambda name: batch.column(batch.schema.get_field_index(name))
    x = _vectors(column("embedding"), dim)
    size = np.sqrt((x * x).sum(1))
    ok = np.ones((len(x), len(m)), bool)
    for name in ("_may", "_asked"):
        if name in batch.schema.names:
            seen = np.zeros_like(ok)
            seen[np.repeat(np.arange(len(x)), pc.list_value_length(column(name)).to_numpy()), column(name).flatten().to_numpy()] = True
            ok &= seen
    if match_department:
        own = np.array(column("department").to_pylist(), object)
        ok &= (departments == "")[None, :] | (own[:, None] == departments[None, :])
    score = np.full(ok.shape, np.nan)
    with np.errstate(invalid="ignore", divide="ignore"):
        # only columns that a row of the batch asks for are multiplied
        asked = np.flatnonzero(ok.any(0))
        score[:, asked] = np.round(x @ m[asked].T / (size[:, None] * norms[asked]), 6)
    score[~ok] = np.nan
    return score


def _slices(batches: Iterator[pa.RecordBatch], queries: int) -> Iterator[pa.RecordBatch]:
    step = max(1, CELLS // max(1, queries))
    for whole in batches:
        for at in range(0, whole.num_rows, step):
            yield whole.slice(at, step)


class Best:
    """The k best of each of n queries among the pairs seen so far, by (score descending, id).

    What is below a query's k-th score so far is left out at once; the rest is held until
    it is twice the k best of all queries, and then cut to them."""

    def __init__(self, n: int, k: int):
        self.k, self.most = k, 2 * n * k
        self.least = np.full(n, -np.inf)
        self.query, self.id, self.score = [], [], []
        self.held = 0

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        if len(score) > self.k:
            # what is below the k-th best of these rows is below that of all
            low = np.where(np.isnan(score), np.inf, -score)
            low.partition(self.k - 1, axis=0)
            self.least = np.maximum(self.least, -low[self.k - 1])
        with np.errstate(invalid="ignore"):
            row, query = np.nonzero(score >= self.least)
        self.query.append(query), self.id.append(ids[row]), self.score.append(score[row, query])
        self.held += len(row)
        if self.held > self.most:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, own, score = (np.concatenate(x or [np.empty(0)]) for x in (self.query, self.id, self.score))
        order = np.lexsort((own, -score, query))
        query, own, score = query[order].astype(np.int64), own[order].astype(np.int64), score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = place == self.k - 1
        self.least[query[last]] = np.maximum(self.least[query[last]], score[last])
        stay = place < self.k
        self.query, self.id, self.score = [query[stay]], [own[stay]], [score[stay]]
        self.held = int(stay.sum())
        return self.query[0], self.id[0], self.score[0]


def block_best(block: DataFrame | Block, chunks: DataFrame, access: DataFrame | None, k: int, match_department: bool = False) -> DataFrame:
    """(query_id, chunk_id, score): the ``k`` best of each task's chunks for each query.

    The block is sent to all tasks; ids and scores leave a task, at most ``k`` a query."""
    asked = block if isinstance(block, Block) else Block(block)
    shared = chunks.sparkSession.sparkContext.broadcast(asked.arrays())
    ids = np.array(asked.ids, np.int64)
    rows = chunks if access is None else asked.allowed(chunks, access)
    columns = ["chunk_id", "embedding", *(["department"] if match_department else []), *(c for c in ("_may", "_asked") if c in rows.columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(ids), k)
        for batch in _slices(batches, len(ids)):
            best.add(_cosines(batch, shared.value, match_department), batch.column(0).to_numpy())
        query, own, score = best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(own), pa.array(score)], names=["query_id", "chunk_id", "score"])

    return rows.where("chunk_id is not null").select(*columns).mapInArrow(run, "query_id long, chunk_id long, score double")


def nearest(queries: DataFrame, chunks: DataFrame, access: DataFrame | None = None, k: int = 20, match_department: bool = False, enforce_acl: bool = True) -> DataFrame:
    """The ``k`` best chunks of each query, with the chunk's columns, ``score`` and ``rank``.

    ``access`` has (user_id, document_id) and is required unless ``enforce_acl`` is False.
    Each task keeps the ``k`` best of every query, only ids and scores are shuffled, and
    the chunks' columns are joined to the final ranking.  Queries are searched in blocks of
    at most ``QUERY_BLOCK``; where there are several, each block's ranking is written.
    Vectors that are null, zero or of another length than the queries' are left out."""
    if enforce_acl and access is None:
        raise ValueError("an access table is required; enforce_acl=False searches without one")
    ranked = ranked_blocks(queries, lambda block: top_k(block_best(block, chunks, access if enforce_acl else None, k, match_department), k))
    return with_chunks(ranked, queries, chunks)


def ranked_blocks(queries: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``search`` over the blocks of the queries; the results of several are written, one
    job a block, so no plan holds more than one."""
    blocks = list(query_blocks(queries))
    if len(blocks) == 1:
        return search(blocks[0])
    path = scratch_path(queries.sparkSession, "blocks")
    for block in blocks:
        found = search(block)
        found.write.mode("append").parquet(path)
    return queries.sparkSession.read.schema(found.schema).parquet(path)


def with_chunks(ranked: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """``ranked`` (query_id, chunk_id, score, rank) with its chunks' columns and user_id."""
    own = queries.select(F.col("query_id").alias("_query"), "user_id")
    rows = ranked.withColumnsRenamed({"chunk_id": "_chunk"}).join(own, F.col("query_id") == F.col("_query")).drop("_query")
    columns = [c for c in chunks.columns if c not in ("query_id", "user_id", "score", "rank")]
    return chunks.select(*columns).join(rows, F.col("chunk_id") == F.col("_chunk")).drop("_chunk")


def scored(queries: DataFrame, chunks: DataFrame, access: DataFrame | None = None, match_department: bool = False, enforce_acl: bool = True) -> DataFrame:
    """(chunk columns, query_id, user_id, score) of all pairs that may be seen.

    For a ranking of a given length use ``nearest``, which shuffles that many pairs only."""
    if enforce_acl and access is None:
        raise ValueError("an access table is required; enforce_acl=False searches without one")
    return ranked_blocks(queries, lambda block: _block_pairs(block, chunks, access if enforce_acl else None, match_department))


def _block_pairs(block: DataFrame, chunks: DataFrame, access: DataFrame | None, match_department: bool) -> DataFrame:
    asked = Block(block)
    shared = chunks.sparkSession.sparkContext.broadcast(asked.arrays())
    ids, users = asked.ids, asked.users
    rows = chunks if access is None else asked.allowed(chunks, access)
    fields = [f for f in chunks.schema.fields if f.name not in ("query_id", "user_id", "score")]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, len(ids)):
            score = _cosines(batch, shared.value, match_department)
            r, c = np.nonzero(np.isfinite(score))
            own = batch.take(pa.array(r))
            yield pa.RecordBatch.from_arrays([*(own.column(own.schema.get_field_index(n)) for n in names), pa.array([ids[k] for k in c], pa.int64()), pa.array([users[k] for k in c], pa.int64()), pa.array(score[r, c])], names=[*names, "query_id", "user_id", "score"])

    return rows.mapInArrow(run, StructType([*fields, StructField("query_id", LongType()), StructField("user_id", LongType()), StructField("score", DoubleType())]))


def top_k(pairs: DataFrame, k: int = 20) -> DataFrame:
    """The k best chunks of each query, with ``rank`` from 1."""
    best = Window.partitionBy("query_id").orderBy(*_by_score())
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def top_per_document(pairs: DataFrame, n: int = 3) -> DataFrame:
    """The n best chunks of each document for each query, with ``doc_rank``."""
    best = Window.partitionBy("query_id", "document_id").orderBy(*_by_score())
    return pairs.withColumn("doc_rank", F.row_number().over(best)).where(F.col("doc_rank") <= n)


def diversify(ranked: DataFrame, k: int = 10, per_doc: int = 3, key: str = "document_id") -> DataFrame:
    """k rows a query: up to ``per_doc`` of each document first, then the deferred."""
    own = Window.partitionBy("query_id", key).orderBy("rank")
    order = Window.partitionBy("query_id").orderBy(F.col("_turn") > per_doc, "rank")
    out = ranked.withColumn("_turn", F.row_number().over(own)).withColumn("final_rank", F.row_number().over(order))
    return out.where(F.col("final_rank") <= k).drop("_turn")


def rerank(ranked: DataFrame, new_score: Column, k: int = 10) -> DataFrame:
    """Candidates by another score; ``original_rank`` keeps where they stood."""
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    out = ranked.withColumn("rerank_score", F.round(new_score, 6)).withColumn("_new", F.row_number().over(order))
    return out.where(F.col("_new") <= k).withColumnRenamed("rank", "original_rank").withColumnRenamed("_new", "rank")


def rerank_or_skip(ranked: DataFrame, new_score: Column, skip: Column, k: int = 10) -> DataFrame:
    """``rerank``, but queries where ``skip`` holds keep their order; the first ``k``."""
    skip = F.coalesce(skip, F.lit(False))
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    out = ranked.withColumn("rerank_score", F.when(skip, -F.col("rank")).otherwise(F.round(new_score, 6)).cast("double")).withColumn("_new", F.row_number().over(order))
    return out.withColumn("rerank_score", F.when(~skip, F.col("rerank_score"))).where(F.col("_new") <= k).withColumnRenamed("rank", "original_rank").withColumnRenamed("_new", "rank")


def mmr(candidates: DataFrame, k: int = 10, weight: float = 0.7) -> DataFrame:
    """Maximal marginal relevance over each query's candidates, greedily.

    ``candidates`` holds (query_id, chunk_id, score, rank, embedding), as many a query as
    were fetched, so a group is bounded by that number.  Ties go to the better rank.
    """

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        x = np.stack(rows["embedding"].to_numpy()).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-10
        sims, rel = x @ x.T, rows["score"].to_numpy(float)
        left, chosen = list(range(len(rows))), []
        while left and len(chosen) < k:
            value = [weight * rel[i] - (1 - weight) * (sims[i, chosen].max() if chosen else 0.0) for i in left]
            chosen.append(left.pop(int(np.argmax(np.round(value, 9)))))
        out = rows.iloc[chosen][["query_id", "chunk_id", "score"]].copy()
        out["mmr_rank"] = range(1, len(out) + 1)
        return out

    return candidates.select("query_id", "chunk_id", "score", "rank", "embedding").groupBy("query_id").applyInPandas(pick, "query_id long, chunk_id long, score double, mmr_rank long")


def by_strategy(queries: DataFrame, chunks: DataFrame, access: DataFrame | None, k: int = 10, fetch_k: int = 40, enforce_acl: bool = True) -> DataFrame:
    """Each query by its own strategy: mmr diversifies, none retrieves nothing, all others
    (cosine, hyde_cosine, unknown or null) rank."""
    own = F.coalesce("strategy", F.lit("cosine"))
    plain, other = queries.where(~own.isin("mmr", "none")), queries.where(own == "mmr")
    a = nearest(plain, chunks, access, k, enforce_acl=enforce_acl).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))
    b = mmr(nearest(other, chunks, access, fetch_k, enforce_acl=enforce_acl), k).select("query_id", "chunk_id", "score", F.col("mmr_rank").alias("rank"))
    return a.unionByName(b)


def assemble(final: DataFrame, expanded: DataFrame) -> DataFrame:
    """Final chunks, then chunks of related documents; ``part`` tells which."""
    cols = ["query_id", "chunk_id", "document_id", "score", "rank"]
    return final.select(*cols, F.lit(0).alias("part")).unionByName(expanded.select(*cols, F.lit(1).alias("part")))


def citations(context: DataFrame) -> DataFrame:
    """The first chunk of each document in context order, numbered per query."""
    first = Window.partitionBy("query_id", "document_id").orderBy("part", "rank", "chunk_id")
    order = Window.partitionBy("query_id").orderBy("part", "rank", "chunk_id")
    out = context.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return out.withColumn("citation", F.row_number().over(order))


def citation_columns(cited: DataFrame) -> DataFrame:
    """Citations as records of what a reader is shown of them."""
    return cited.select("query_id", "citation", "document_id", F.col("title").alias("document_title"), "url", "department", "chunk_id", "page_numbers", F.col("heading").alias("section_heading"), "score")


def citation_events(cited: DataFrame) -> DataFrame:
    """Citations once per title; a missing title is 'Unknown'."""
    named = cited.withColumn("title", F.coalesce("title", F.lit("Unknown")))
    first = Window.partitionBy("query_id", "title").orderBy("citation")
    return named.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def seeds(ranked: DataFrame, most: int = 10) -> DataFrame:
    """Distinct documents of the first ``most`` results of each query."""
    return ranked.where(F.col("rank") <= most).select("query_id", "document_id").distinct()


def export_records(ranked: DataFrame, content: str = "content") -> DataFrame:
    """Plain result records: content cut to 800 characters, score to three places."""
    return ranked.select("query_id", "rank", "chunk_id", F.substring(content, 1, 800).alias("content"), F.round("score", 3).alias("score"))


def context_text(ranked: DataFrame, chunks: int = 8, each: int = 800, total: int = 12_000) -> DataFrame:
    """One context text per query: the first chunks, cut, joined and cut again."""
    rows = ranked.where(F.col("rank") <= chunks).select("query_id", F.struct("rank", F.substring("content", 1, each).alias("t")).alias("r"))
    text = rows.groupBy("query_id").agg(F.concat_ws("\n\n", F.transform(F.array_sort(F.collect_list("r")), lambda r: r["t"])).alias("context"))
    return text.withColumn("context", F.when(F.length("context") > total, F.concat(F.substring("context", 1, total), F.lit("\n[truncated]"))).otherwise(F.col("context")))


def numbered_context(ranked: DataFrame, related: DataFrame | None = None) -> DataFrame:
    """``[i] title - heading`` blocks per query, in rank order; then, where there are any,
    the summaries of ``related`` (query_id, document_id, summary) documents."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("title", F.lit("Unknown")), F.when(F.col("heading").isNotNull(), F.concat(F.lit(" - "), F.col("heading"))).otherwise(F.lit("")), F.lit("\n"), F.col("content"))
    rows = ranked.select("query_id", F.struct("rank", line.alias("t")).alias("r"))
    out = rows.groupBy("query_id").agg(F.concat_ws("\n\n", F.transform(F.array_sort(F.collect_list("r")), lambda r: r["t"])).alias("context"))
    if related is None:
        return out
    more = related.where("summary is not null").groupBy("query_id").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("document_id", "summary"))), lambda r: F.concat(F.lit("- "), r["summary"]))).alias("_more"))
    return out.join(more, "query_id", "left").select("query_id", F.concat_ws("\n\n", "context", F.concat(F.lit("Related:\n"), F.col("_more"))).alias("context"))


def department_context(ranked: DataFrame, queries: DataFrame, sizes: dict[str, int], default: int = 5) -> DataFrame:
    """Results up to the context size of their query's department (query_id, department)."""
    size = F.lit(default)
    for name, n in sizes.items():
        size = F.when(F.col("_asked") == name, n).otherwise(size)
    asked = queries.select(F.col("query_id").alias("_query"), F.col("department").alias("_asked"))
    return ranked.join(asked, F.col("query_id") == F.col("_query")).where(F.col("rank") <= size).drop("_query", "_asked")


def exclude_retrieved(related: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Related documents that the query has not retrieved, each once (its first by rank)."""
    seen = retrieved.select("query_id", "document_id").distinct()
    fresh = related.join(seen, ["query_id", "document_id"], "left_anti")
    if "rank" not in related.columns:
        return fresh.dropDuplicates(["query_id", "document_id"])
    first = Window.partitionBy("query_id", "document_id").orderBy("rank")
    return fresh.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


# Relevance of a related document by its first relation, if it has no weight.
RELATION_WEIGHTS = {
    "SUPERSEDES": 0.95,
    "CITES": 0.90,
    "SHARES_ENTITY": 0.70,
    "RELATED_TO": 0.60,
    "SHARES_TOPIC": 0.50,
}
OTHER_RELATION, NO_RELATION = 0.5, "RELATED_TO"


def related_scores(related: DataFrame, sources: DataFrame | None = None, access_levels: list[str] | None = None) -> DataFrame:
    """``related`` (query_id, document_id, types, weight, position) with ``relevance`` and
    ``rank``: the weight, else that of the first of its types (none: as RELATED_TO).

    Of repeated documents the first by position counts; those of ``sources`` (query_id,
    document_id), and with ``access_levels`` those of other levels, go."""
    rows = related.where("document_id is not null")
    if access_levels is not None:
        rows = rows.where(F.col("access_level").isNull() | F.col("access_level").isin(access_levels))
    if sources is not None:
        rows = rows.join(sources.select("query_id", "document_id").distinct(), ["query_id", "document_id"], "left_anti")
    first = Window.partitionBy("query_id", "document_id").orderBy("position")
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    kind = F.coalesce(F.get("types", F.lit(0)), F.lit(NO_RELATION))
    fallback = F.lit(OTHER_RELATION)
    for name, weight in RELATION_WEIGHTS.items():
        fallback = F.when(kind == name, weight).otherwise(fallback)
    rows = rows.withColumn("relevance", F.round(F.coalesce("weight", fallback), 6))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "position")))


def retrieval_metrics(ranked: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """precision and recall at k per query, over (query_id, document_id) expected."""
    got = ranked.where(F.col("rank") <= k).select("query_id", "document_id").distinct()
    hit = got.join(expected.distinct(), ["query_id", "document_id"]).groupBy("query_id").agg(F.count("*").alias("hits"))
    want = expected.distinct().groupBy("query_id").agg(F.count("*").alias("expected"))
    have = got.groupBy("query_id").agg(F.count("*").alias("found"))
    out = want.join(have, "query_id", "left").join(hit, "query_id", "left").fillna(0, ["found", "hits"])
    return out.select("query_id", F.when(F.col("found") > 0, F.round(F.col("hits") / F.col("found"), 6)).otherwise(F.lit(0.0)).alias("precision"), F.round(F.col("hits") / F.col("expected"), 6).alias("recall"))


def sufficiency(judged: DataFrame, top: int = 3, needed: int = 2) -> DataFrame:
    """Per query: relevant among the first ``top``, and whether that is enough."""
    order = Window.partitionBy("query_id").orderBy("rank_key")
    first = judged.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top)
    out = first.groupBy("query_id").agg(F.sum("relevant").cast("long").alias("relevant"))
    return out.withColumn("sufficient", F.col("relevant") >= needed)


def clamp_k(k: Column) -> Column:
    """A requested k, held between 1 and 10."""
    return F.greatest(F.lit(1), F.least(k, F.lit(10)))


