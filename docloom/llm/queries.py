"""The registered queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import content_sort, decontam, hard_negatives, html_extract, minhash, mixing, pii, pq_dedup, prefix_trie, rlz_dedup, token_counts, tokenbin, toxicity

#: Where the public tokenizer files lie; None: what ``public_tokenizers`` says.
TOKENIZERS: str | None = None


def tokenizer(name: str) -> str:
    import public_tokenizers

    return f"{TOKENIZERS}/{name}" if TOKENIZERS else str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = pii.find(table(spark, sf_dir, "documents"))
    kinds = F.array(*[F.lit(k) for k in pii.KINDS])
    said = lambda rows: F.array_join(F.transform(rows, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{pii.KINDS[k]}") for k in range(pii.BASE)],
        F.sha2(said(base), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
        *[F.size(F.filter("spans", lambda s, k=k: s["kind"] == k)).cast("long").alias(f"n_{pii.KINDS[k]}") for k in range(pii.BASE, len(pii.KINDS))],
        F.size("spans").cast("long").alias("n_spans"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact ten-word benchmark windows in every document."""
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near").cast("long").alias("n_near_items"),
    )


def op3_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents in patched frame-of-reference files, read back."""
    return tokenbin.round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all embeddings at cosine 0.9."""
    return pq_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document under the piece vocabulary."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without their repeated twenty-word windows."""
    out = rlz_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document in a mixture weighted by the root of source size."""
    out = mixing.mixed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "block", "place", "slot", "release", "deadline")


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations."""
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding, some of which have a wrong label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 100 == 0)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of equal texts of every document; the largest id stays."""
    return content_sort.exact_duplicates(table(spark, sf_dir, "documents"), largest=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_decontamination": op2_decontamination,
    "op3_token_blocks": op3_token_blocks,
    "op4_toxicity": op4_toxicity,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_source_mix": op8_source_mix,
    "op9_minhash_dedup": op9_minhash_dedup,
    "op10_html_text": op10_html_text,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_exact_dedup": op13_exact_dedup,
}

_WORDS2 = "list_filter(regexp_split_to_array(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

ORACLES: dict[str, str] = {
    "op2_decontamination": f"""
with b as (select item_id, {_WORDS2.format("text")} as w from benchmark where item_id is not null),
d as (select doc_id, {_WORDS2.format("text")} as w from documents),
p as (select distinct item_id, least(10, len(w)) as n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as g, w[i : i + least(10, len(w)) - 1] as pw
      from b, lateral (select unnest(generate_series(1, greatest(1, len(w) - 9))) as i) where len(w) > 0),
g as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as g from d, (select distinct n from p) l,
      lateral (select unnest(generate_series(1, greatest(0, len(w) - n + 1))) as i)),
h as (select doc_id, item_id, i, p.n from g join p on p.n = g.n and p.g = g.g),
c as (select doc_id, count(distinct j) as n_hit from h, lateral (select unnest(generate_series(i, i + n - 1)) as j) group by doc_id),
o as (select doc_id, w, unnest(w) as x, generate_subscripts(w, 1) as i from d),
y as (select doc_id, count(distinct item_id) as n_near from o join p on p.pw[1] = o.x where list_has_all(w[greatest(1, i - 20) : i + 20], pw) group by doc_id),
s as (select doc_id, count(distinct item_id) as n_items, array_to_string(list_sort(list(distinct cast(item_id as varchar))), ',') as ids from h group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(n_near, 0) as n_near_items
from d left join c using (doc_id) left join s using (doc_id) left join y using (doc_id)""",
    "op5_embedding_dedup": """
with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings),
l as (select a.vec_id as a, b.vec_id as b from v a, v b where a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.9),
r as (select vec_id as n, vec_id as m from v union select r.n, l.b from r join l on l.a = r.m),
c as (select n, min(m) as component_id from r group by n), k as (select a, count(*) as n_links from l group by a)
select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept from v join c on c.n = vec_id left join k on k.a = vec_id""",
    "op7_substring_dedup": """
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
g as (select doc_id, i, array_to_string(w[i : i + 19], ' ') as g from d, lateral (select unnest(generate_series(1, len(w) - 19)) as i)),
f as (select doc_id, i, row_number() over (partition by g order by doc_id, i) as n from g),
c as (select distinct doc_id, i + k as j from f, range(20) r(k) where n > 1),
u as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as j from d),
k as (select doc_id, count(c.j) as n_removed, string_agg(case when c.j is null then x end, ' ' order by j) as kept from u left join c using (doc_id, j) group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (doc_id)""",
    "op8_source_mix": f"""
with recursive sz as (select source, count(*) as n from documents group by source),
br as (select greatest({mixing.BLOCK_ROWS}, (cast(sum(n) as bigint) + {mixing.SLOTS - 1}) // {mixing.SLOTS}) as rows from sz),
un as (select source, greatest(1, cast(floor(sqrt(n) * 1000) as bigint)) as unit, (n + rows - 1) // rows as blocks from sz, br),
o as (select list(source order by source) as names, list(unit order by source) as u, list(blocks order by source) as b, cast(sum(unit) as bigint) as total, cast(sum(blocks) as bigint) as steps from un),
t(step, had, pick, pos, block) as (select cast(0 as bigint), list_transform(u, lambda x: cast(0 as bigint)), cast(0 as bigint), cast(-1 as bigint), cast(0 as bigint) from o
  union all select y.step + 1, list_transform(y.had, lambda c, i: c + cast(i = y.p as bigint)), y.p, y.now, y.had[y.p] from (
    select w.step, w.had, w.now, list_min(list_filter(list_transform(u, lambda x, i: case when w.had[i] < b[i] and w.had[i] * total // x <= w.now then ((w.had[i] + 1) * total + x - 1) // x * 100000 + i end), lambda z: z is not null)) % 100000 as p
    from (select t.step, t.had, greatest(t.pos + 1, list_min(list_filter(list_transform(u, lambda x, i: case when t.had[i] < b[i] then t.had[i] * total // x end), lambda z: z is not null))) as now from t, o where t.step < steps) w, o) y),
pl as (select names[pick] as source, block, pos as slot, block * total // u[pick] as release, ((block + 1) * total + u[pick] - 1) // u[pick] as deadline from t, o where step > 0),
rk as (select doc_id, source, row_number() over (partition by source order by doc_id, md5(coalesce(text, ''))) - 1 as r from documents)
select doc_id, rk.source, pl.block, r % rows as place, slot, release, deadline from rk, br, pl where pl.source = rk.source and pl.block = r // rows""",
    "op11_prefix_trie": """
with b as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda v, k: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end)) as bits),
t as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first) as p, coalesce(role, '') as r, coalesce(text, '') as x from conversations where conv_id is not null),
k as (select c, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(c as varchar), ''), lambda x: cast(ascii(x) as bigint))), lambda a, y: xor(a >> 8, bits[(xor(a, y) & 255) + 1])), 4294967295) % 9 as h from (select distinct c from t), b),
u as (select k.c, 0 as part, p, r, x from k join t on t.c = k.c - k.c % 5 and p <= h union all select k.c, 1, p, r, x from k join t on t.c = k.c and p > h),
l as (select k.c, coalesce(list({'r': r, 'x': x} order by part, p) filter (r is not null), []) as w from k left join u using (c) group by k.c),
m as (select c, len(w) as turns, d, strlen(coalesce(w[d].x, '')) as bytes, list_transform(range(d + 1), lambda i: md5(cast(to_json(w[1:i]) as varchar))) as keys from l, lateral (select unnest(range(len(w) + 1)) as d)),
n as (select keys[-1] as key, any_value(keys) as keys, d as depth, any_value(bytes) as bytes, min(c) as conv_id, count(*) as n_convs, coalesce(string_agg(c, ',' order by c) filter (turns = d), '') as ends from m group by keys[-1], d),
ch as (select keys[-2] as key, count(*) as n_children from n where depth > 0 group by 1),
s as (select a as key, sum(case when ch.key is null then 1 else 0 end) as n_leaves, sum((n_convs - 1) * bytes) as saved_tokens from (select key as own, unnest(keys) as a, n_convs, bytes from n) x left join ch on ch.key = own group by a)
select n.conv_id, n.depth, up.conv_id as parent_conv_id, n.n_convs, coalesce(n_children, 0) as n_children, cast(n_leaves as bigint) as n_leaves, cast(saved_tokens as bigint) as saved_tokens, sha256(n.ends) as ends_sha256
from n join s on s.key = n.key left join ch on ch.key = n.key left join n up on n.depth > 0 and up.key = n.keys[-2]""",
    "op12_hard_negatives": """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as double)) as e
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id as other_id, cast(list_inner_product(a.e, b.e) as bigint) as score from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.e) = len(b.e)),
p as (select anchor_id, other_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select p.anchor_id, positive_id, cast(row_number() over (partition by p.anchor_id, positive_id order by score desc, other_id) as integer) as rank, other_id as negative_id, positive_score, score as negative_score
from p join s on s.anchor_id = p.anchor_id and not same and 80 * positive_score <= 100 * score and score <= positive_score
qualify row_number() over (partition by p.anchor_id, positive_id order by score desc, other_id) <= 5""",
    "op13_exact_dedup": """
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size, doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256 from d""",
}
