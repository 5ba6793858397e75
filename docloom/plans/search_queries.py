"""Queries of vector search, ranking, the graph and the lexical index."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions.hooks import hashed_vector, lexical_overlap
from docloom.operators import graph, lexical, search, vector_index
from docloom.plans.registry import query
from docloom.sources.scratch import scratch_path

#: Lists that a query of the stored index searches.
PROBES = 8

COSINE = "round(list_cosine_similarity(cast(q.embedding as double[]), cast(c.embedding as double[])), 6)"
ACL_PAIRS = f"""pairs as (select q.query_id, c.chunk_id, c.document_id, c.title, c.department, c.url, c.heading, c.page_numbers, {COSINE} as score
  from {{queries}} q join {{access}} a on a.user_id = q.user_id join {{chunks}} c on c.document_id = a.document_id)"""
ALL_PAIRS = f"""pairs as (select q.query_id, c.chunk_id, c.document_id, c.title, c.department, c.kb, {COSINE} as score from {{queries}} q, {{chunks}} c)"""
RANKED = "ranked as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from pairs)"
DIVERSE = """turns as (select *, row_number() over (partition by query_id, document_id order by rank) as turn from ranked where rank <= 40),
  final as (select *, row_number() over (partition by query_id order by turn > 3, rank) as final_rank from turns)"""
CITED = """cited as (select query_id, chunk_id, document_id, title, url, department, page_numbers, heading, score, final_rank, row_number() over (partition by query_id, document_id order by final_rank) as n from final where final_rank <= 10)"""


def _long(df, *cols):
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


def _ranked(t, k=40):
    return search.nearest(t("queries"), t("chunks"), t("access"), k)


def flagship(t):
    """Access-checked ranking, diversified, cited: the whole retrieval of a question."""
    final = search.diversify(_ranked(t), 10, 3)
    context = final.drop("rank", "embedding").withColumnRenamed("final_rank", "rank").withColumn("part", F.lit(0))
    return _long(search.citation_columns(search.citations(context)), "citation")


query(
    "retrieve_citations",
    f"""with {ACL_PAIRS}, {RANKED}, {DIVERSE}, {CITED}
    select query_id, row_number() over (partition by query_id order by final_rank) as citation, document_id, title as document_title, url, department, chunk_id, page_numbers, heading as section_heading, score from cited where n = 1""",
)(flagship)


@query("top_k_access", f"with {ACL_PAIRS}, {RANKED} select query_id, chunk_id, document_id, score, rank from ranked where rank <= 10")
def top_k_access(t):
    return _long(_ranked(t, 10).select("query_id", "chunk_id", "document_id", "score", "rank"), "rank")


@query("top_k_all", f"with {ALL_PAIRS}, {RANKED} select query_id, chunk_id, score, rank from ranked where rank <= 20")
def top_k_all(t):
    """An administrator's search: access is not checked."""
    return _long(search.nearest(t("queries"), t("chunks"), k=20, enforce_acl=False).select("query_id", "chunk_id", "score", "rank"), "rank")


OWN = f"""from {{queries}} q join {{access}} a on a.user_id = q.user_id join {{chunks}} c on c.document_id = a.document_id"""


@query(
    "top_k_filtered",
    f"""with pairs as (select q.query_id, c.chunk_id, {COSINE} as score {OWN} where c.content_type = 'policy' and c.extraction_method = 'ocr' and c.created_at >= timestamp '2022-01-01 00:00:00' and c.created_at <= timestamp '2023-01-01 00:00:00'
      and (c.access_level in ('public') or c.access_level is null) and (q.department is null or q.department = c.department)), {RANKED}
      select query_id, chunk_id, score, rank from ranked where rank <= 10""",
)
def top_k_filtered(t):
    import datetime

    day = datetime.datetime
    chunks = t("chunks").where(search.metadata_filter(content_type="policy", extraction_method="ocr", access_levels=["public"], created_from=day(2022, 1, 1), created_to=day(2023, 1, 1)))
    return _long(search.nearest(t("queries"), chunks, t("access"), 10, match_department=True).select("query_id", "chunk_id", "score", "rank"), "rank")


@query(
    "top_k_care",
    f"""with pairs as (select q.query_id, c.chunk_id, {COSINE} as score, case when c.document_id % 2 = 0 then 'https://policies.example.org/' || c.document_id end as policy_url, case c.department when 'hr' then 'people' else c.department end as category {OWN} where c.kb = 'care'), {RANKED}
      select query_id, chunk_id, score, rank, policy_url, category from ranked where rank <= 8""",
)
def top_k_care(t):
    """The second knowledge base is the same search behind a filter on ``kb``; its rows
    have a policy address, and their department is called category."""
    chunks = t("chunks").where("kb = 'care'").withColumns({"policy_url": F.when(F.col("document_id") % 2 == 0, F.concat(F.lit("https://policies.example.org/"), F.col("document_id").cast("string"))), "category": F.when(F.col("department") == "hr", "people").otherwise(F.col("department"))})
    return _long(search.nearest(t("queries"), chunks, t("access"), 8).select("query_id", "chunk_id", "score", "rank", "policy_url", "category"), "rank")


@query(
    "top_k_completed",
    f"""with pairs as (select q.query_id, c.chunk_id, {COSINE} as score {OWN} where c.document_id in (select document_id from {{doc_status}} where status = 'completed')), {RANKED}
      select query_id, chunk_id, score, rank from ranked where rank <= 5""",
)
def top_k_completed(t):
    return _long(search.nearest(t("queries"), search.completed_only(t("chunks"), t("doc_status")), t("access"), 5).select("query_id", "chunk_id", "score", "rank"), "rank")


@query("in_given_documents", f"with pairs as (select q.query_id, c.chunk_id, {COSINE} as score {OWN} where c.document_id in (select document_id from {{doc_status}} where status = 'pending')), {RANKED} select query_id, chunk_id, rank from ranked where rank <= least(10, greatest(1, cast(query_id / 100 as bigint)))")
def in_given_documents(t):
    """A search inside given documents, with each query's own k held between 1 and 10."""
    some = search.in_documents(t("chunks"), t("doc_status").where("status = 'pending'"))
    ranked = search.nearest(t("queries"), some, t("access"), 10)
    return _long(ranked.where(F.col("rank") <= search.clamp_k(F.expr("query_id div 100"))).select("query_id", "chunk_id", "rank"), "rank")


@query(
    "top_per_document",
    f"with {ACL_PAIRS}, r as (select *, row_number() over (partition by query_id, document_id order by score desc, chunk_id) as doc_rank from pairs) select query_id, document_id, chunk_id, score, doc_rank from r where doc_rank <= 3",
)
def top_per_document(t):
    out = search.top_per_document(search.scored(t("queries"), t("chunks"), t("access")), 3)
    return _long(out.select("query_id", "document_id", "chunk_id", "score", "doc_rank"), "doc_rank")


@query("diversified", f"with {ACL_PAIRS}, {RANKED}, {DIVERSE} select query_id, chunk_id, document_id, final_rank from final where final_rank <= 10")
def diversified(t):
    return _long(search.diversify(_ranked(t), 10, 3).select("query_id", "chunk_id", "document_id", "final_rank"), "final_rank")


@query(
    "reranked",
    f"""with {ACL_PAIRS}, {RANKED}, r as (select query_id, chunk_id, rank as original_rank, round(score + 1e0 / (3 + chunk_id % 5), 6) as rerank_score from ranked where rank <= 40),
      n as (select *, row_number() over (partition by query_id order by rerank_score desc, original_rank) as rank from r) select query_id, chunk_id, original_rank, rerank_score, rank from n where rank <= 10""",
)
def reranked(t):
    out = search.rerank(_ranked(t), F.col("score") + 1.0 / (3 + F.col("chunk_id") % 5), 10)
    return _long(out.select("query_id", "chunk_id", "original_rank", "rerank_score", "rank"), "original_rank", "rank")


@query(
    "rerank_skipped",
    f"""with {ACL_PAIRS}, {RANKED}, r as (select query_id, chunk_id, rank as original_rank, query_id % 200 = 0 as skip, case when query_id % 200 <> 0 then round(score + 1e0 / (3 + chunk_id % 5), 6) end as rerank_score from ranked where rank <= 40),
      n as (select *, row_number() over (partition by query_id order by case when skip then -original_rank else rerank_score end desc, original_rank) as rank from r) select query_id, chunk_id, original_rank, rerank_score, rank from n where rank <= 10""",
)
def rerank_skipped(t):
    """Reranking, left out for every other query."""
    out = search.rerank_or_skip(_ranked(t), F.col("score") + 1.0 / (3 + F.col("chunk_id") % 5), F.col("query_id") % 200 == 0, 10)
    return _long(out.select("query_id", "chunk_id", "original_rank", "rerank_score", "rank"), "original_rank", "rank")


# Greedy selection as a recursion over the list of what is chosen; ties go to the better rank.
MMR = f"""m as (select query_id, chunk_id, score, rank, cast(embedding as double[]) as e from (select r.*, c.embedding from ranked r join {{chunks}} c using (chunk_id) where rank <= 40)),
  pair as (select x.query_id, x.rank as i, y.rank as j, list_cosine_similarity(x.e, y.e) as sim from m x join m y using (query_id)),
  pick(query_id, n, chosen, best) as (select query_id, cast(0 as bigint), cast([] as bigint[]), cast(null as bigint) from (select distinct query_id from m)
    union all select query_id, n + 1, list_append(chosen, next), next from (
      select p.query_id, p.n, p.chosen, arg_min(m.rank, (-round(0.7 * m.score - 0.3 * coalesce((select max(sim) from pair where pair.query_id = p.query_id and pair.i = m.rank and list_contains(p.chosen, pair.j)), 0), 9), m.rank)) as next
      from pick p join m on m.query_id = p.query_id and not list_contains(p.chosen, m.rank) where p.n < 10 group by p.query_id, p.n, p.chosen))"""


@query("mmr_selection", f"with recursive {ACL_PAIRS}, {RANKED}, {MMR} select p.query_id, m.chunk_id, m.score, p.n as mmr_rank from pick p join m on m.query_id = p.query_id and m.rank = p.best where p.n > 0")
def mmr_selection(t):
    return search.mmr(_ranked(t), 10)


@query(
    "strategy_dispatch",
    f"""with recursive {ACL_PAIRS}, {RANKED}, {MMR} select p.query_id, m.chunk_id, m.score, p.n as rank from pick p join m on m.query_id = p.query_id and m.rank = p.best where p.n > 0 and p.query_id in (select query_id from {{queries}} where strategy = 'mmr')
      union all select query_id, chunk_id, score, rank from ranked where rank <= 10 and query_id in (select query_id from {{queries}} where coalesce(strategy, 'cosine') not in ('mmr', 'none'))""",
)
def strategy_dispatch(t):
    return search.by_strategy(t("queries"), t("chunks"), t("access"))


@query("seed_documents", f"with {ACL_PAIRS}, {RANKED} select distinct query_id, document_id from ranked where rank <= 10")
def seed_documents(t):
    return search.seeds(_ranked(t))


@query(
    "citation_events",
    f"""with {ACL_PAIRS}, {RANKED}, {DIVERSE}, named as (select *, case when document_id % 3 = 0 then 'Unknown' else title end as t2 from final where final_rank <= 10),
      d as (select *, row_number() over (partition by query_id, document_id order by final_rank) as n from named),
      e as (select *, row_number() over (partition by query_id, t2 order by final_rank) as m from d where n = 1) select query_id, t2 as title, chunk_id from e where m = 1""",
)
def citation_events(t):
    final = search.diversify(_ranked(t), 10, 3).withColumn("title", F.when(F.col("document_id") % 3 != 0, F.col("title")))
    context = final.select("query_id", "chunk_id", "document_id", "title", F.col("final_rank").alias("rank"), F.lit(0).alias("part"))
    return search.citation_events(search.citations(context)).select("query_id", "title", "chunk_id")


@query(
    "context_text",
    f"""with {ACL_PAIRS}, {RANKED} select query_id, case when length(s) > 200 then substr(s, 1, 200) || chr(10) || '[truncated]' else s end as context from (
      select query_id, string_agg(substr(title || ' of ' || department, 1, 30), chr(10) || chr(10) order by rank) as s from ranked where rank <= 8 group by query_id)""",
)
def context_text(t):
    rows = _ranked(t).withColumn("content", F.concat("title", F.lit(" of "), "department"))
    return search.context_text(rows, 8, 30, 200)


@query(
    "numbered_context",
    f"""with {ACL_PAIRS}, {RANKED}, c as (select query_id, string_agg('[' || rank || '] ' || title || ' - ' || department || chr(10) || 'chunk ' || chunk_id, chr(10) || chr(10) order by rank) as context from ranked where rank <= 6 group by query_id),
      r as (select query_id, string_agg('- About ' || document_id, chr(10) order by document_id) as more from (select distinct query_id, document_id from ranked where rank > 6 and rank <= 12 and document_id % 2 = 0) x group by query_id)
      select query_id, context || coalesce(chr(10) || chr(10) || 'Related:' || chr(10) || more, '') as context from c left join r using (query_id)""",
)
def numbered_context(t):
    ranked = _ranked(t, 12)
    rows = ranked.where("rank <= 6").withColumns({"heading": F.col("department"), "content": F.concat(F.lit("chunk "), F.col("chunk_id").cast("string"))})
    summary = F.when(F.col("document_id") % 2 == 0, F.concat(F.lit("About "), F.col("document_id").cast("string")))
    return search.numbered_context(rows, ranked.where("rank > 6").select("query_id", "document_id", summary.alias("summary")).distinct())


@query(
    "department_context",
    f"""with {ACL_PAIRS}, {RANKED} select r.query_id, chunk_id, r.department, rank from ranked r join {{queries}} q on q.query_id = r.query_id where rank <= case q.department when 'hr' then 6 when 'finance' then 8 when 'sales' then 6 when 'marketing' then 6 else 5 end""",
)
def department_context(t):
    # fixed values: chunks of context by department
    sizes = {"hr": 6, "finance": 8, "sales": 6, "marketing": 6}
    out = search.department_context(_ranked(t), t("queries").select("query_id", "department"), sizes, 5)
    return _long(out.select("query_id", "chunk_id", "department", "rank"), "rank")


@query("export_records", f"with {ACL_PAIRS}, {RANKED} select query_id, rank, chunk_id, substr(repeat(title || ' ', 60 + chunk_id % 60), 1, 800) as content, round(score, 3) as score from ranked where rank <= 10")
def export_records(t):
    rows = _ranked(t, 10).withColumn("content", F.expr("repeat(title || ' ', cast(60 + chunk_id % 60 as int))"))
    return _long(search.export_records(rows), "rank")


@query(
    "retrieval_metrics",
    f"""with {ACL_PAIRS}, {RANKED}, got as (select distinct query_id, document_id from ranked where rank <= 10), want as (select distinct q.query_id, d.document_id from {{queries}} q, {{chunks}} d where d.document_id % 8 = cast(q.query_id / 100 as bigint) % 8),
      h as (select query_id, count(*) as hits from got join want using (query_id, document_id) group by query_id), g as (select query_id, count(*) as found from got group by query_id), w as (select query_id, count(*) as expected from want group by query_id)
      select query_id, case when coalesce(found, 0) > 0 then round(coalesce(hits, 0) / found, 6) else 0.0 end as precision, round(coalesce(hits, 0) / expected, 6) as recall from w left join g using (query_id) left join h using (query_id)""",
)
def retrieval_metrics(t):
    want = t("chunks").select("document_id").distinct().join(t("queries").select("query_id"), F.expr("document_id % 8 = query_id div 100 % 8")).select("query_id", "document_id")
    return search.retrieval_metrics(_ranked(t, 10), want)


@query(
    "sufficiency",
    "with r as (select *, row_number() over (partition by query_id order by rank_key) as n from {judged}) select query_id, cast(sum(relevant) as bigint) as relevant, sum(relevant) >= 2 as sufficient from r where n <= 3 group by query_id",
)
def sufficiency(t):
    return search.sufficiency(t("judged"))


@query(
    "related_documents",
    f"""with {ACL_PAIRS}, {RANKED}, seeds as (select distinct query_id, document_id from ranked where rank <= 10),
      e0 as (select src, dst, type, strength, count from {{edges}} where dst is not null and src <> dst), e as (select * from e0 union all select dst, src, type, strength, count from e0),
      w as (select *, round(case type when 'SUPERSEDES' then 0.95 when 'CITES' then 0.9 when 'SHARES_ENTITY' then 0.5 + coalesce(count, 0) * 0.05 when 'RELATED_TO' then coalesce(strength, 0.5) else 0.3 end, 6) as weight from e),
      near as (select s.query_id, s.document_id as src, w.dst, w.type, w.weight, row_number() over (partition by s.query_id, s.document_id order by w.weight desc, w.dst, w.type) as n from seeds s join w on w.src = s.document_id
        join {{queries}} q on q.query_id = s.query_id join {{access}} a on a.user_id = q.user_id and a.document_id = w.dst where coalesce(w.dst % 9, 1) <> 4),
      rolled as (select query_id, dst as document_id, array_to_string(list_sort(list(distinct type)), ',') as types, max(weight) as weight from near where n <= 20 group by query_id, dst),
      out as (select r.*, row_number() over (partition by r.query_id order by weight desc, r.document_id) as rank from rolled r left join seeds s on s.query_id = r.query_id and s.document_id = r.document_id where s.query_id is null)
      select query_id, document_id, types, weight, rank from out where rank <= 5""",
)
def related_documents(t):
    """Expansion of each query's seed documents over the relations."""
    edges = t("edges")
    levels = t("documents").select(F.col("doc_id").alias("document_id"), F.when(F.col("doc_id") % 9 == 4, "secret").alias("access_level"))
    seeds = search.seeds(_ranked(t)).join(t("queries").select("query_id", "user_id"), "query_id")
    out = graph.expand(seeds, edges, t("access"), levels=levels, access_levels=["public"])
    return _long(out.withColumn("types", F.concat_ws(",", "types")), "rank")


@query(
    "related_chunks",
    f"""with {ACL_PAIRS}, {RANKED}, top as (select * from ranked where rank <= 10), rel as (select distinct query_id, document_id + 3 as document_id from top),
      fresh as (select r.* from rel r where not exists (select 1 from top t where t.query_id = r.query_id and t.document_id = r.document_id)),
      x as (select p.*, row_number() over (partition by p.query_id, p.document_id order by p.score desc, p.chunk_id) as n from pairs p join fresh f on f.query_id = p.query_id and f.document_id = p.document_id)
      select query_id, chunk_id, document_id, score, rank, cast(0 as bigint) as part from top union all select query_id, chunk_id, document_id, score, n, 1 from x where n <= 6""",
)
def related_chunks(t):
    """Final chunks, then the best chunks of related documents not yet retrieved."""
    pairs = search.scored(t("queries"), t("chunks"), t("access"))
    top = search.top_k(pairs, 10)
    related = top.select("query_id", (F.col("document_id") + 3).alias("document_id")).distinct()
    fresh = search.exclude_retrieved(related, top)
    more = search.top_per_document(pairs.join(fresh, ["query_id", "document_id"], "left_semi"), 6).withColumnRenamed("doc_rank", "rank")
    return _long(search.assemble(top, more), "rank", "part")


@query("approximate_recall")
def approximate_recall(t):
    """recall@10 of the stored inverted-list index against the exact ranking, and the share
    of the index that each query's lists hold."""
    chunks, asked = t("chunks"), t("queries")
    path = scratch_path(chunks.sparkSession, "vector-index")
    vector_index.build(chunks, path)
    got = vector_index.search(path, asked, t("access"), 10, PROBES).select("query_id", "chunk_id")
    exact = _ranked(t, 10).select("query_id", "chunk_id")
    hit = got.join(exact, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.count("*").alias("hits"))
    out = exact.groupBy("query_id").agg(F.count("*").alias("n")).join(hit, "query_id", "left").join(vector_index.share_read(path, asked, PROBES), "query_id")
    return out.select("query_id", F.round(F.coalesce("hits", F.lit(0)) / F.col("n"), 6).alias("recall"), F.round("share", 6).alias("share"))


TERMS = "list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')"
BM25 = f"""qt as (select distinct conv_id as query_id, unnest({TERMS}) as term from {{conversations}} where turn = 1 and conv_id % 100 = 0),
  d as (select doc_id, {TERMS} as w from {{documents}}), st as (select count(*) as total, avg(len(w)) as mean from d), dt as (select doc_id, len(w) as length, unnest(w) as term from d),
  tf as (select doc_id, length, term, count(*) as tf from dt where term in (select term from qt) group by doc_id, length, term), df as (select term, count(*) as df from tf group by term),
  sc as (select query_id, doc_id, round(sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 4) as score from tf join df using (term) join qt using (term), st group by query_id, doc_id),
  lex as (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from sc)"""


def _lexical(t, k=10):
    asked = t("conversations").where("turn = 1 and conv_id % 100 = 0").select(F.col("conv_id").alias("query_id"), "text")
    return lexical.bm25(asked, t("documents").select("doc_id", "text"), k)


@query("bm25", f"with {BM25} select query_id, doc_id, score, rank from lex where rank <= 10")
def bm25(t):
    return _long(_lexical(t), "rank")


HASHED = """list_transform(range(32), lambda i: cast(len(list_filter(list_transform(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> ''), lambda w: cast('0x' || substr(md5(w), 1, 4) as bigint) % 32), lambda p: p = i)) as double))"""


@query(
    "hybrid_fusion",
    f"""with {BM25}, qv as (select conv_id as query_id, {HASHED} as v from {{conversations}} where turn = 1 and conv_id % 100 = 0), dv as (select doc_id, {HASHED} as v from {{documents}}),
      vs as (select query_id, doc_id, round(list_cosine_similarity(qv.v, dv.v), 6) as score from qv, dv where list_sum(qv.v) > 0 and list_sum(dv.v) > 0), o as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as rank from vs qualify rank <= 30),
      f as (select query_id, doc_id, round(sum(1.0 / (60 + rank)), 6) as fused from (select query_id, doc_id, rank from lex where rank <= 30 union all select * from o) group by query_id, doc_id),
      r as (select *, row_number() over (partition by query_id order by fused desc, doc_id) as rank from f) select query_id, doc_id, fused, rank from r where rank <= 10""",
)
def hybrid_fusion(t):
    """Reciprocal rank fusion of the lexical with the vector ranking."""
    asked = t("conversations").where("turn = 1 and conv_id % 100 = 0").select(F.col("conv_id").alias("query_id"), F.lit(None).cast("long").alias("user_id"), hashed_vector(F.col("text"), 32).alias("embedding"), F.lit(None).cast("string").alias("department"))
    docs = t("documents").select(F.col("doc_id").alias("chunk_id"), hashed_vector(F.col("text"), 32).alias("embedding"))
    near = search.nearest(asked, docs, k=30, enforce_acl=False).select("query_id", F.col("chunk_id").alias("doc_id"), "rank")
    return _long(lexical.fuse(_lexical(t, 30), near), "rank")


# ---- graph -----------------------------------------------------------------


@query("next_chunk_edges", "with e as (select chunk_id as src, lead(chunk_id) over (partition by document_id order by sequence_number, chunk_id) as dst from {chunks}) select src, dst, 'NEXT_CHUNK' as type from e where dst is not null")
def next_chunk_edges(t):
    return graph.next_chunk_edges(t("chunks"))


@query("graph_index", "select document_id, chunk_id, row_number() over (partition by document_id order by sequence_number, chunk_id) - 1 as index from {chunks}")
def graph_index(t):
    return graph.graph_index(t("chunks"))


@query("structure_edges", "select document_id as src, cast(chunk_id as varchar) as dst, 'CONTAINS' as type from {chunks} union all select distinct document_id, department, 'BELONGS_TO' from {chunks} where department is not null")
def structure_edges(t):
    return graph.contains_edges(t("chunks")).withColumn("dst", F.col("dst").cast("string")).unionByName(graph.belongs_edges(t("chunks")))


SAID = "case event_type when 'purchase' then 'Entity ' when 'view' then 'ENTITY ' else 'entity ' end || cast(floor(user_id / 5) as bigint)"
SAYS = f"says as (select {SAID} as name, 'aka ' || event_type as alias, case when user_id % 2 = 0 then 'ORG' else 'PERSON' end as type, cast(floor(event_id / 200) as bigint) as document_id, cast(floor(event_id / 20) as bigint) as chunk_id, 'part ' || event_id % 3 as heading, cast(1 as bigint) as n, event_id as first_at from {{events}})"


def _says(t):
    """Mentions in three spellings, with their chunk and section."""
    return t("events").select(F.expr(SAID).alias("name"), F.when(F.col("user_id") % 2 == 0, "ORG").otherwise("PERSON").alias("type"), F.expr("event_id div 200").alias("document_id"), F.expr("event_id div 20").alias("chunk_id"), F.array(F.concat(F.lit("aka "), "event_type")).alias("aliases"), F.concat(F.lit("part "), (F.col("event_id") % 3).cast("string")).alias("heading"), F.lit(1).cast("long").alias("n"), F.col("event_id").alias("first_at"))


def _joined(df, *columns):
    return df.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in columns})


@query(
    "merged_entities",
    f"""with {SAYS}, m as (select document_id, lower(trim(name)) as key, type, cast(sum(n) as bigint) as n, arg_min(name, first_at) as name, list_sort(list(distinct name)) as names, list_sort(list(distinct chunk_id)) as c, list_sort(list(distinct heading)) as s from says group by 1, 2, 3)
      select document_id, key, type, n, name, array_to_string(c, ',') as chunk_ids, array_to_string(s, ',') as sections, array_to_string(list_filter(names, lambda x: x <> name), ',') as aliases from m""",
)
def merged_entities(t):
    return _joined(graph.merge_entities(_says(t)), "chunk_ids", "sections", "aliases")


@query(
    "entity_vertices",
    f"with {SAYS} select lower(trim(name)) as key, type, arg_min(name, first_at) as name, min(first_at) as first_at, arg_min(alias, first_at) as aliases from says group by 1, 2",
)
def entity_vertices(t):
    return _joined(graph.entity_vertices(_says(t)), "aliases")


@query("mentions_in_chunks", f"with {SAYS} select lower(trim(name)) as key, type, chunk_id, cast(sum(n) as bigint) as count, array_to_string(list_sort(list(distinct heading)), ',') as sections from says group by 1, 2, 3")
def mentions_in_chunks(t):
    return _joined(graph.mentions_in_chunks(_says(t)), "sections")


@query("document_vertices", "select document_id, max(sequence_number) as modified_at, title, arg_max(department, (sequence_number, -ascii(department))) as department from {chunks} group by document_id, title")
def document_vertices(t):
    rows = t("chunks").select("document_id", F.col("sequence_number").alias("modified_at"), "title", "department")
    return graph.document_vertices(rows, ["department", "title"])


@query("chunk_vertices", "select chunk_id, document_id, row_number() over (partition by document_id order by sequence_number, chunk_id) - 1 as index, department as heading, substr(repeat(title || ' ', 40), 1, 200) as summary from {chunks}")
def chunk_vertices(t):
    return graph.chunk_vertices(t("chunks").withColumns({"heading": F.col("department"), "content": F.expr("repeat(title || ' ', 40)")}))


@query("mentioned_edges", f"with {SAYS} select name, type, document_id, cast(sum(n) as bigint) as count, array_to_string(list_sort(list(distinct heading)), ',') as sections from says group by 1, 2, 3")
def mentioned_edges(t):
    return _joined(graph.mentioned_edges(_says(t)), "sections")


@query("topic_graph", "select topic, max_by(struct_pack(d := department), document_id).d as department, count(*) as documents from {topics} group by topic")
def topic_graph(t):
    covered = graph.topic_edges(t("topics")).groupBy(F.col("dst").alias("topic")).agg(F.count("*").alias("documents"))
    return graph.topic_vertices(t("topics")).join(covered, "topic")


SHARED = "select x.document_id as a, y.document_id as b, count(*) as n, array_to_string(list_sort(list(distinct x.{0})), ',') as names from s x join s y on x.{0} = y.{0} and x.document_id < y.document_id group by 1, 2"


@query("shares_entity", "with s as (select distinct document_id, name from {mentions}) " + SHARED.format("name") + " having count(*) >= 2")
def shares_entity(t):
    out = graph.shared(t("mentions"), "name", 2)
    return out.withColumn("names", F.concat_ws(",", "names"))


@query("shares_topic", "with s as (select distinct document_id, topic from {topics}) " + SHARED.format("topic"))
def shares_topic(t):
    return graph.shared(t("topics"), "topic", 1).withColumn("names", F.concat_ws(",", "names"))


@query("topic_partners", "select x.document_id as a, y.document_id as b, count(*) as n from (select distinct document_id, topic from {topics} where document_id % 100 = 0) x join (select distinct document_id, topic from {topics}) y on x.topic = y.topic and x.document_id <> y.document_id group by 1, 2")
def topic_partners(t):
    """Documents that share a topic with every hundredth document: only what is asked for of
    the pairs of ``shares_topic``."""
    rows = t("topics").select("document_id", F.col("topic").alias("item")).where("item is not null").distinct()
    return graph.shared_with(rows.where("document_id % 100 = 0"), rows, 1).select("a", "b", "n")


@query("superseding", "select src as document_id, dst as newer from {edges} where type = 'SUPERSEDES' and dst is not null and src in (select document_id from {chunks})")
def superseding(t):
    return graph.superseding(t("chunks"), t("edges"))


@query(
    "entity_lookup",
    """with w as (select distinct user_id % 20 as user_id, name, type from (select user_id, 'Entity ' || user_id as name, case when user_id % 2 = 0 then 'ORG' else 'PERSON' end as type from {events}) x),
      h as (select user_id, name, type, document_id, n from w join (select name, type, document_id, cast(sum(n) as bigint) as n from {mentions} group by all) m using (name, type) join {access} a using (user_id, document_id)),
      r as (select *, row_number() over (partition by user_id, name, type order by n desc, document_id) as rank from h) select * from r where rank <= 10""",
)
def entity_lookup(t):
    wanted = t("events").select((F.col("user_id") % 20).alias("user_id"), F.concat(F.lit("Entity "), F.col("user_id").cast("string")).alias("name"), F.when(F.col("user_id") % 2 == 0, "ORG").otherwise("PERSON").alias("type")).distinct()
    out = graph.entity_lookup(t("mentions"), wanted, t("access"))
    return _long(out.select("user_id", "name", "type", "document_id", "n", "rank"), "rank")


@query(
    "document_context",
    """with s as (select a.user_id, a.document_id from {access} a join (select distinct document_id from {chunks}) c on c.document_id = a.document_id where a.user_id % 10 = 3),
      d as (select * from (select * from s union select user_id, document_id + 1 from s) x semi join {access} using (user_id, document_id)), e as (select document_id, array_to_string(list_sort(list(distinct name)), ',') as entities from {mentions} group by 1),
      t as (select document_id, array_to_string(list_sort(list(distinct topic)), ',') as topics from {topics} group by 1), c as (select src as document_id, array_to_string(list_sort(list(distinct dst)), ',') as cites from {edges} where type = 'CITES' group by 1)
      select user_id, document_id, entities, topics, cites from d left join e using (document_id) left join t using (document_id) left join c using (document_id)""",
)
def document_context(t):
    """Every tenth user's documents, and as many more, of which the hidden ones go."""
    seen = t("access").where("user_id % 10 = 3").select("user_id", "document_id").join(t("chunks").select("document_id").distinct(), "document_id")
    ids = seen.unionByName(seen.withColumn("document_id", F.col("document_id") + 1))
    out = graph.document_context(ids, t("mentions"), t("topics"), t("edges"), t("access"))
    joined = lambda c: F.when(F.col(c).isNotNull(), F.array_join(F.transform(c, lambda x: x.cast("string")), ",")).alias(c)
    return out.select("user_id", "document_id", joined("entities"), joined("topics"), joined("cites"))


@query(
    "two_hops",
    """with s as (select query_id, user_id, document_id from {queries} join {access} using (user_id) where document_id % 4 = 1), e0 as (select src, dst from {edges} where dst is not null and src <> dst), e as (select * from e0 union select dst, src from e0),
      h1 as (select distinct s.query_id, s.user_id, e.dst as document_id from s join e on e.src = s.document_id join {access} a on a.user_id = s.user_id and a.document_id = e.dst where (s.query_id, e.dst) not in (select query_id, document_id from s)),
      h2 as (select distinct h.query_id, e.dst as document_id from h1 h join e on e.src = h.document_id join {access} a on a.user_id = h.user_id and a.document_id = e.dst where (h.query_id, e.dst) not in (select query_id, document_id from s union select query_id, document_id from h1))
      select query_id, document_id, 1 as hop from h1 union all select query_id, document_id, 2 from h2""",
)
def two_hops(t):
    """Documents within two visible steps of a quarter of what each query's user may see."""
    seeds = t("queries").join(t("access"), "user_id").where("document_id % 4 = 1").select("query_id", "user_id", "document_id")
    return graph.expand_hops(seeds, t("edges"), t("access"))


@query(
    "related_scores",
    """with e as (select src as query_id, dst as document_id, type, case when type <> 'RELATED_TO' or dst % 3 = 0 then strength end as weight, case when dst % 4 = 0 then 'secret' end as access_level from {edges} where dst is not null
        union all select doc_id, doc_id + 2, 'SHARES_TOPIC', null, null from {documents} union all select doc_id, doc_id + 5, 'MENTIONS', null, null from {documents} union all select doc_id, doc_id + 11, null, null, 'public' from {documents}),
      o as (select *, row_number() over (partition by query_id order by coalesce(type, ''), document_id, weight) as position from e),
      f as (select * from o where document_id <> query_id and (access_level is null or access_level = 'public') qualify row_number() over (partition by query_id, document_id order by position) = 1),
      s as (select query_id, document_id, position, coalesce(weight, case type when 'SUPERSEDES' then 0.95 when 'CITES' then 0.9 when 'SHARES_ENTITY' then 0.7 when 'SHARES_TOPIC' then 0.5 when 'MENTIONS' then 0.5 else 0.6 end) as relevance from f)
      select query_id, document_id, relevance, row_number() over (partition by query_id order by relevance desc, position) as rank from s""",
)
def related_scores(t):
    """Scores of related documents with and without a weight, of every kind of relation, of
    an unknown kind and of none; repeats, the source itself and hidden ones go."""
    weight = F.when((F.col("type") != "RELATED_TO") | (F.col("dst") % 3 == 0), F.col("strength"))
    rows = t("edges").where("dst is not null").select(F.col("src").alias("query_id"), F.col("dst").alias("document_id"), "type", weight.alias("weight"), F.when(F.col("dst") % 4 == 0, "secret").alias("access_level"))
    for far, kind, level in ((2, "SHARES_TOPIC", None), (5, "MENTIONS", None), (11, None, "public")):
        rows = rows.unionByName(t("documents").select(F.col("doc_id").alias("query_id"), (F.col("doc_id") + far).alias("document_id"), F.lit(kind).cast("string").alias("type"), F.lit(None).cast("double").alias("weight"), F.lit(level).cast("string").alias("access_level")))
    order = Window.partitionBy("query_id").orderBy(F.coalesce("type", F.lit("")), "document_id", F.asc_nulls_last("weight"))
    rows = rows.withColumn("position", F.row_number().over(order)).withColumn("types", F.when(F.col("type").isNotNull(), F.array("type")))
    own = t("documents").select(F.col("doc_id").alias("query_id"), F.col("doc_id").alias("document_id"))
    return _long(search.related_scores(rows, own, ["public"]).select("query_id", "document_id", "relevance", "rank"), "rank")


@query("graph_delete", "select src, dst, type from {edges} where dst is not null and src % 5 <> 0 and dst % 5 <> 0")
def graph_delete(t):
    gone = t("documents").where("doc_id % 5 = 0").select(F.col("doc_id").alias("document_id"))
    gone = gone.union(gone.sparkSession.range(0, 1000, 5).toDF("document_id"))
    return graph.delete_from_graph(t("edges").where("dst is not null"), gone).select("src", "dst", "type")


@query("merged_vertices", "select topic, arg_max(lang, document_id) as lang, max(document_id) as document_id from {topics} group by topic")
def merged_vertices(t):
    rows = t("topics").select("topic", "lang", "document_id")
    return graph.merge_vertices(rows.where("document_id % 2 = 0"), rows.where("document_id % 2 = 1"), ["topic"], "document_id")


@query(
    "lexical_rerank",
    """with q as (select conv_id as query_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')) as w from {conversations} where turn = 1),
      d as (select doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')) as w from {documents})
      select query_id, doc_id, case when len(q.w) > 0 then round(len(list_intersect(q.w, d.w)) / len(q.w), 6) else 0.0 end as overlap from q join d on d.doc_id % 200 = q.query_id""",
)
def lexical_rerank(t):
    q = t("conversations").where("turn = 1").select(F.col("conv_id").alias("query_id"), F.col("text").alias("q_text"))
    rows = q.join(t("documents"), F.col("doc_id") % 200 == F.col("query_id"))
    return rows.select("query_id", "doc_id", F.round(lexical_overlap(F.col("q_text"), F.col("text")), 6).alias("overlap"))
