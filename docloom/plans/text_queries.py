"""Queries of the text rules, chunkers, sheets and default hooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import hooks, tables, text
from docloom.operators import changes, chunking, metrics
from docloom.plans.registry import query

ASKED = "asked as (select conv_id, turn, text, lower(text) as low from {conversations} where role = 'user')"
# Questions and, written out by hand, what the rules say of each: kind, department, strategy,
# document type, content type, complex, department by name, by score, routed strategy, date range.
EXPECTED = """
0|What is our PTO policy?|factual|hr|cosine||policy|f||hr|cosine||
1|How to submit an expense report?|procedural|finance|mmr||report|f|||mmr||
2|Compare Q3 vs Q4 sales trends|analytical||hyde_cosine|||t|sales||hyde_cosine||
3|Create a presentation about Q4 sales|generative||cosine|pptx|presentation|t|sales||hyde_cosine||
4|What is our leave policy?|factual|hr|cosine||policy|f||hr|cosine||
5|Show me the latest budget report|factual|finance|cosine||report|f|finance||cosine||
6|What's the current pipeline value?|factual|sales|cosine|||f|sales||cosine||
7|What campaigns are running?|factual||cosine|||f|||cosine||
8|Tell me about the company|factual||cosine|||f|||cosine||
9|Generate a report document|generative||cosine|docx|report|t|||hyde_cosine||
10|Create a spreadsheet with budget data|generative|finance|cosine|xlsx|spreadsheet|t|finance||hyde_cosine||
11|Steps to onboard a new employee|procedural||mmr|||f|||mmr||
12|Thanks!|smalltalk||cosine|||f|||none||
13|How do I build the sales forecast for our clients?|generative|finance|cosine|||t|sales||mmr||
14|invoices of the last 30 days, revenue and tax|factual|finance|cosine|||f|sales|finance|cosine|2024-01-01|2024-01-31
15|revenue in Q2 2023|factual|finance|cosine|||f|sales||cosine|2023-04-01|2023-07-01
16|hiring since 2021|factual||cosine|||f|||cosine|2021-01-01|2024-01-31
17|reports of last month|factual||cosine||report|f|||cosine|2023-12-01|2024-01-01
18|guide to benefits and payroll this quarter|factual||cosine|||f||hr|mmr|2024-01-01|2024-01-31
19|compare benefits of last week with last 1 day|analytical||hyde_cosine|||t|||hyde_cosine|2024-01-30|2024-01-31
20|news of this week|factual||cosine|||f|||cosine|2024-01-29|2024-01-31
21|news of last week|factual||cosine|||f|||cosine|2024-01-22|2024-01-29
22|budget of this month|factual|finance|cosine|||f|finance||cosine|2024-01-01|2024-01-31
23|budget of last quarter|factual|finance|cosine|||f|finance|finance|cosine|2023-10-01|2024-01-01
24|plan for this year|factual||cosine|||f|||cosine|2024-01-01|2024-01-31
25|results of last year|factual||cosine|||f|||cosine|2023-01-01|2024-01-01
26|deals in 2022|factual||cosine|||f|sales||cosine|2022-01-01|2023-01-01
27|within 2021 nothing|factual||cosine|||f|||cosine||
28|Bahrain office on the third floor|factual||cosine|||f|||cosine||
29|What are the pros and cons of a vs b, a guide|factual||cosine|||f|||hyde_cosine||
30|  OK. |smalltalk||cosine|||f|||none||
31|human resources summary for people ops|analytical||hyde_cosine|||f|hr||hyde_cosine||
""".strip("\n")
EXPECTED = [x.split("|") for x in EXPECTED.split("\n")]
QUESTIONS = [x[1] for x in EXPECTED]
TITLES = (
    "expected(k, q, kind, department, strategy, document_type, content_type, complex, named, by_score, routed, since, until) as (values "
    + ", ".join("(" + ", ".join([x[0], *(f"nullif('{v.replace(chr(39), chr(39) * 2)}', '')" for v in x[1:])]) + ")" for x in EXPECTED)
    + "), titles as (select doc_id, expected.* from {documents} join expected on doc_id % 32 = k)"
)


def _titles(t):
    """Every document under a question, so that rules meet all the tables' rows."""
    q = None
    for i, x in enumerate(QUESTIONS):
        q = F.when(F.col("doc_id") % 32 == i, x) if q is None else q.when(F.col("doc_id") % 32 == i, x)
    return t("documents").select("doc_id", q.alias("q"), "text")


WORDS = "list_filter(regexp_split_to_array({0}, '[ \\t\\n\\r]+'), lambda x: x <> '')"


@query("query_analysis", f"with {TITLES} select doc_id, kind, department, strategy, document_type, content_type, complex = 't' as complex from titles")
def query_analysis(t):
    q = F.col("q")
    kind = text.query_type(q)
    return _titles(t).select("doc_id", kind.alias("kind"), text.department(q).alias("department"), text.strategy(kind).alias("strategy"), text.document_type(q).alias("document_type"), text.content_type(q).alias("content_type"), text.is_complex(q).alias("complex"))


@query(
    "question_turns",
    f"""with {ASKED} select conv_id, turn, case when regexp_matches(low, '^\\s*(hi|hello|hey|howdy|hola|greetings|yo|sup|good (morning|afternoon|evening|day)|how are you|hows it going|how do you do|whats up|thanks|thank you( so much)?|thx|ty|cheers|bye|goodbye|see you|take care|later|cya|have a (good|nice) day|ok|okay|alright|sure|got it|understood|cool|nice|great|awesome|who are you|what (are you|can you do|do you do)|help)[!?.,:; ]*$') then 'smalltalk'
        when regexp_matches(low, 'create|generate|make|build') then 'generative' when regexp_matches(low, 'how to|steps|process|procedure') then 'procedural' when regexp_matches(low, 'compare|analyze|trend|summary') then 'analytical' else 'factual' end as kind,
        substr(text, 1, 2000) = text as whole, length(text) > 100 as long from asked""",
)
def question_turns(t):
    rows = t("conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", text.query_type(F.col("text")).alias("kind"), (F.substring("text", 1, 2000) == F.col("text")).alias("whole"), (F.length("text") > 100).alias("long"))


@query("routed_strategy", f"with {TITLES} select doc_id, case when kind <> 'smalltalk' and doc_id % 3 = 2 then 'mmr' else routed end as strategy from titles")
def routed_strategy(t):
    given = F.when(F.col("doc_id") % 3 == 0, None).when(F.col("doc_id") % 3 == 1, "cosine").otherwise("mmr")
    return _titles(t).select("doc_id", text.routed_strategy(F.col("q"), given).alias("strategy"))


@query("department_rules", f"with {TITLES} select doc_id, by_score, named, coalesce(case when doc_id % 5 = 0 then 'hr' end, named, case when doc_id % 2 = 0 then 'sales' end) as filtered from titles")
def department_rules(t):
    given, own = F.when(F.col("doc_id") % 5 == 0, "hr"), F.when(F.col("doc_id") % 2 == 0, "sales")
    return _titles(t).select("doc_id", text.department_by_score(F.col("q")).alias("by_score"), text.named_department(F.col("q")).alias("named"), text.filter_department(given, F.col("q"), own).alias("filtered"))


PATHS = "case position % 8 when 0 then '/Talent/x' when 1 then '/a/Human Resources' when 2 then '/threshold' when 3 then '/FY/Fiscal' when 4 then '/Deals-2023' when 5 then '/comms' else parent_path end"


@query(
    "path_departments",
    """select position, case position % 8 when 0 then 'hr' when 1 then 'hr' when 2 then null when 3 then 'finance' when 4 then 'sales' when 5 then 'marketing' else case split_part(split_part(parent_path, ':/', 2), '/', 1) when 'HR' then 'hr' when 'Finance' then 'finance' when 'Sales' then 'sales' end end as department,
      case position % 8 when 0 then 'hr' when 1 then 'hr' when 2 then 'hr' when 3 then 'finance' when 4 then 'sales' when 5 then 'marketing' else case split_part(split_part(parent_path, ':/', 2), '/', 1) when 'HR' then 'hr' when 'Finance' then 'finance' when 'Sales' then 'sales' end end as inside,
      case position % 4 when 0 then 'sales' when 1 then 'hr' else 'general' end as normal from {feed}""",
)
def path_departments(t):
    path = F.expr(PATHS)
    name = F.expr("case position % 4 when 0 then ' Sales ' when 1 then 'HR' when 2 then 'legal' end")
    return t("feed").select("position", text.department_from_path(path).alias("department"), text.department_from_path(path, True).alias("inside"), text.normal_department(name).alias("normal"))


@query("date_ranges", f"with {TITLES} select doc_id, cast(since as timestamp) as since, cast(until as timestamp) as until from titles")
def date_ranges(t):
    a, b = text.date_range(F.col("q"), F.lit("2024-01-31").cast("timestamp"))
    return _titles(t).select("doc_id", a.cast("timestamp_ntz").alias("since"), b.cast("timestamp_ntz").alias("until"))


@query(
    "scrubbed_text",
    """with x as (select doc_id, text || case doc_id % 4 when 0 then ' ssn 123456789 or 123.45.6789' when 1 then ' call 5551234567, (555) 123-4567 or 1-555-123-4567' when 2 then ' mail A.b@C.Org' else '' end as text from {documents})
      select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}\\b', '[EMAIL]', 'gi'), '\\b\\d{3}[-.\\s]?\\d{2}[-.\\s]?\\d{4}\\b', '[SSN]', 'g'), '\\b(\\+1[-.\\s]?)?\\(?\\d{3}\\)?[-.\\s]?\\d{3}[-.\\s]?\\d{4}\\b', '[PHONE]', 'g')) as digest from x""",
)
def scrubbed_text(t):
    more = F.expr("text || case doc_id % 4 when 0 then ' ssn 123456789 or 123.45.6789' when 1 then ' call 5551234567, (555) 123-4567 or 1-555-123-4567' when 2 then ' mail A.b@C.Org' else '' end")
    return t("documents").select("doc_id", F.md5(text.scrub(more)).alias("digest"))


@query(
    "text_counts",
    f"""select doc_id, len({WORDS.format('text')}) as words, len(string_split(text, chr(10))) as lines, len(regexp_extract_all(text, '[A-Za-z0-9_\\x{{80}}-\\x{{10FFFF}}]+|[!-/:-@\\[-^`{{-~]')) as tokens from {{documents}}""",
)
def text_counts(t):
    return t("documents").select("doc_id", text.word_count(F.col("text")).cast("long").alias("words"), F.size(F.split("text", "\n")).cast("long").alias("lines"), text.token_count(F.col("text")).cast("long").alias("tokens"))


@query("lenient_json", "select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k from {events}")
def lenient_json(t):
    fenced = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.col("props"))
    parsed = F.from_json(text.fenced_json(fenced), "k bigint", {"mode": "PERMISSIVE"})
    return t("events").select("event_id", parsed["k"].alias("k"))


@query(
    "edge_weights",
    """select src, dst, type, round(case type when 'SUPERSEDES' then 0.95 when 'CITES' then 0.9 when 'SHARES_ENTITY' then 0.5 when 'RELATED_TO' then coalesce(strength, 0.5) else 0.3 end, 6) as weight from {edges}""",
)
def edge_weights(t):
    return t("edges").select("src", "dst", "type", F.round(text.edge_weight(F.col("type"), F.lit(0), F.col("strength")), 6).alias("weight"))


@query("path_ids", "select position, 'local-drive-' || substr(md5(parent_path || '/' || name), 1, 12) as drive_id, 'local-item-' || substr(md5(parent_path || '/' || name), 13, 12) as item_id, sha256(name) as content_hash from {feed}")
def path_ids(t):
    return t("feed").select("position", *text.path_ids(F.concat("parent_path", F.lit("/"), "name")), F.sha2("name", 256).alias("content_hash"))


NOTICES = """n as (select event_id, case event_id % 11 when 0 then 'sites/' when 1 then 'drives' else 'drives/' end || user_id || case when event_id % 5 = 0 then '' else '/root' end as resource,
  'site' || (event_id % 3) || case when event_id % 7 = 0 then '' else ':' || user_id || case event_id % 4 when 0 then ':s3' when 1 then ':no' when 2 then ':s3:more' else '' end end as state from {events})"""


@query(
    "notices",
    f"""with {NOTICES} select split_part(resource, '/', 2) as drive_id, split_part(state, ':', 1) as site_id, count(*) as n from n
      where split_part(resource, '/', 1) = 'drives' and contains(resource, '/') and split_part(state, ':', 3) = 's3' group by 1, 2""",
)
def notices(t):
    """Verified notifications of each drive; others, and those of no drive, go."""
    e = F.col("event_id")
    resource = F.concat(F.when(e % 11 == 0, "sites/").when(e % 11 == 1, "drives").otherwise("drives/"), F.col("user_id").cast("string"), F.when(e % 5 == 0, "").otherwise("/root"))
    secret = F.when(e % 4 == 0, ":s3").when(e % 4 == 1, ":no").when(e % 4 == 2, ":s3:more").otherwise("")
    state = F.concat(F.lit("site"), (e % 3).cast("string"), F.when(e % 7 == 0, "").otherwise(F.concat(F.lit(":"), F.col("user_id").cast("string"), secret)))
    rows = t("events").select(resource.alias("resource"), state.alias("client_state"))
    return changes.notifications(rows, "s3").groupBy("drive_id", "site_id").agg(F.count("*").alias("n"))


@query(
    "merged_metadata",
    """with d as (select distinct drive_id, item_id, 60 + item_id % 90 as n_chars from {feed}),
      f as (select drive_id, item_id, created_by, modified_by, modified_at, url, parent_path from {feed} qualify row_number() over (partition by drive_id, item_id order by modified_at desc, position desc) = 1),
      p as (select drive_id, item_id, retry_count + 1 as page_count, 'Title ' || item_id as title from {stored} where item_id % 3 <> 0)
      select d.drive_id, d.item_id, created_by, modified_by, modified_at, url, coalesce(page_count, 0) as page_count, cast(0 as bigint) as word_count, title,
        case when n_chars > 100 then case d.item_id % 3 when 0 then 'policy' else 'guide' end end as content_type, case when n_chars > 100 and d.item_id % 4 <> 0 then 'de' else 'en' end as language,
        case when contains(lower(parent_path), 'hr') then 'hr' when contains(lower(parent_path), 'finance') then 'finance' when contains(lower(parent_path), 'sales') then 'sales' when n_chars > 100 then 'general' end as department
      from d left join f using (drive_id, item_id) left join p using (drive_id, item_id)""",
)
def merged_metadata(t):
    """Metadata by priority: feed, then the file's properties, then what the text gave."""
    docs = t("feed").select("drive_id", "item_id", (60 + F.col("item_id") % 90).alias("n_chars")).distinct()
    files = t("stored").where("item_id % 3 <> 0").select("drive_id", "item_id", (F.col("retry_count") + 1).alias("page_count"), F.concat(F.lit("Title "), F.col("item_id").cast("string")).alias("title"))
    derived = docs.select("drive_id", "item_id", F.when(F.col("item_id") % 3 == 0, "policy").otherwise("guide").alias("content_type"), F.when(F.col("item_id") % 4 != 0, "de").alias("language"), F.lit("general").alias("department"))
    out = changes.merge_metadata(docs, changes.last_per_key(t("feed")), files, derived)
    columns = ["created_by", "modified_by", "url", "title", "content_type", "language", "department"]
    return out.select("drive_id", "item_id", *columns, F.col("modified_at").cast("timestamp_ntz").alias("modified_at"), *[F.col(c).cast("long").alias(c) for c in ("page_count", "word_count")])


@query(
    "truncated_tokens",
    """with k as (select doc_id, text, regexp_extract_all(text, '(?:[A-Za-z0-9_\\x{80}-\\x{10FFFF}]+|[!-/:-@\\[-^`{-~])[ \\t\\n\\r]*') as w from {documents})
      select doc_id, md5(case when len(w) <= 100 then text else regexp_replace(array_to_string(w[1:100], ''), '[ \\t\\n\\r]+$', '') end) as digest from k""",
)
def truncated_tokens(t):
    """Texts cut after their hundredth token."""
    return t("documents").select("doc_id", F.md5(text.truncate_tokens(F.col("text"), 100)).alias("digest"))


@query(
    "regex_entities",
    """with e as (select doc_id as document_id, 'MONEY' as type, unnest(regexp_extract_all(text, '[$][0-9][0-9,.]*')) as name from {documents} union all select doc_id, 'DATE', unnest(regexp_extract_all(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}')) from {documents}
      union all select doc_id, 'NAME', unnest(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)+')) from {documents}) select document_id, type, name, count(*) as n from e group by all""",
)
def regex_entities(t):
    return hooks.regex_entities(t("documents").withColumnRenamed("doc_id", "document_id"))


@query(
    "default_vectors",
    """with p as (select doc_id, list_transform(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> ''), lambda w: cast('0x' || substr(md5(w), 1, 4) as bigint) % 32) as places from {documents})
      select doc_id, array_to_string(list_transform(range(32), lambda i: len(list_filter(places, lambda x: x = i))), ',') as vector from p""",
)
def default_vectors(t):
    """Default embeddings: hashed word counts of every document."""
    return t("documents").select("doc_id", hooks.hashed_vector(F.col("text"), 32).alias("v")).select("doc_id", F.array_join(F.transform("v", lambda x: x.cast("int").cast("string")), ",").alias("vector"))


# ---- chunking --------------------------------------------------------------

PARTS = "parts as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') as p, text from {documents})"
COUNT = "len(regexp_extract_all({0}, '[A-Za-z0-9_\\x{{80}}-\\x{{10FFFF}}]+|[!-/:-@\\[-^`{{-~]'))"
KEPT = f"a.held[list_min(list_filter(generate_series(1, len(a.held) + 1), lambda j: coalesce(list_sum(list_transform(a.held[j:], lambda z: {COUNT.format('z')})), 0) <= 60)):]"
PACKED = f"""packed as (select doc_id, list_reduce(p, lambda a, x: case when len(a.held) > 0 and a.n + {COUNT.format('x')} > 600
    then struct_pack(out := list_append(a.out, array_to_string(a.held, chr(10) || chr(10))), held := list_append({KEPT}, x), n := cast(coalesce(list_sum(list_transform({KEPT}, lambda u: {COUNT.format('u')})), 0) + {COUNT.format('x')} as bigint))
    else struct_pack(out := a.out, held := list_append(a.held, x), n := cast(a.n + {COUNT.format('x')} as bigint)) end,
    struct_pack(out := cast([] as varchar[]), held := cast([] as varchar[]), n := cast(0 as bigint))) as s from parts),
  chunked as (select doc_id, case when len(s.held) > 0 then list_append(s.out, array_to_string(s.held, chr(10) || chr(10))) else s.out end as c from packed),
  flat as (select doc_id, unnest(c) as content, generate_subscripts(c, 1) - 1 as k from chunked)"""


def _documents(t, summary: bool = False):
    s = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Summary of "), F.col("doc_id").cast("string"))) if summary else F.lit(None).cast("string")
    return t("documents").select(F.col("doc_id").alias("document_id"), "text", s.alias("summary"))


@query("paragraphs", f"with {PARTS} select doc_id, len(p) as n, md5(array_to_string(p, '#')) as digest from parts")
def paragraphs(t):
    return t("documents").select("doc_id", chunking.paragraphs(F.col("text")).alias("p")).select("doc_id", F.size("p").cast("long").alias("n"), F.md5(F.concat_ws("#", "p")).alias("digest"))


@query(
    "chunked_documents",
    f"""with {PARTS}, {PACKED} select doc_id as document_id, k as sequence_number, 'text' as chunk_type, {COUNT.format('content')} as token_count, md5(content) as digest from flat
      union all select doc_id, -1, 'summary', 3, md5('Summary of ' || doc_id) from {{documents}} where doc_id % 4 = 0""",
)
def chunked_documents(t):
    """Packed chunks of every document, a summary chunk first where there is one."""
    out = chunking.chunk_documents(_documents(t, True))
    return out.select("document_id", "sequence_number", "chunk_type", "token_count", F.md5("content").alias("digest"))


FLUSHED = "case when len(a.held) > 0 then list_append(a.out, struct_pack(c := array_to_string(a.held, chr(10) || chr(10)), k := 'text')) else a.out end"
TABLED = f"""tabled as (select doc_id, list_transform(p, lambda x, i: case when i % 5 = 3 then '| ' || x || ' |' else x end) as p from parts),
  folded as (select doc_id, list_reduce(p, lambda a, x: case when starts_with(x, '|')
    then struct_pack("out" := list_append({FLUSHED}, struct_pack(c := x, k := 'table')), held := cast([] as varchar[]), n := cast(0 as bigint))
    when len(a.held) > 0 and a.n + {COUNT.format('x')} > 600
    then struct_pack("out" := {FLUSHED}, held := list_append({KEPT}, x), n := cast(coalesce(list_sum(list_transform({KEPT}, lambda u: {COUNT.format('u')})), 0) + {COUNT.format('x')} as bigint))
    else struct_pack("out" := a.out, held := list_append(a.held, x), n := cast(a.n + {COUNT.format('x')} as bigint)) end,
    struct_pack("out" := cast([] as struct(c varchar, k varchar)[]), held := cast([] as varchar[]), n := cast(0 as bigint))) as a from tabled),
  cut as (select doc_id, {FLUSHED} as o from folded)"""


@query(
    "chunked_tables",
    f"""with {PARTS}, {TABLED}, x as (select doc_id, unnest(o) as c, generate_subscripts(o, 1) - 1 as k from cut)
      select doc_id as document_id, k as sequence_number, c.k as chunk_type, {COUNT.format('c.c')} as token_count, md5(c.c) as digest from x""",
)
def chunked_tables(t):
    """Texts with tables between their paragraphs: a table is a chunk of its own."""
    lines = F.transform(chunking.paragraphs(F.col("text")), lambda x, i: F.when((i + 1) % 5 == 3, F.concat(F.lit("| "), x, F.lit(" |"))).otherwise(x))
    docs = t("documents").select(F.col("doc_id").alias("document_id"), F.concat_ws("\n", lines).alias("text"), F.lit(None).cast("string").alias("summary"))
    return chunking.chunk_documents(docs).select("document_id", "sequence_number", "chunk_type", "token_count", F.md5("content").alias("digest"))


@query(
    "chunked_by_table_function",
    f"""with {PARTS}, {PACKED} select doc_id as document_id, k as sequence_number, 'text' as chunk_type, {COUNT.format('content')} as token_count, md5(content) as digest from flat
      union all select doc_id, -1, 'summary', 3, md5('Summary of ' || doc_id) from {{documents}} where doc_id % 4 = 0""",
)
def chunked_by_table_function(t):
    """The same chunks from SQL: a table function joined to every document."""
    docs = _documents(t, True)
    tables.register(docs.sparkSession)
    return docs.sparkSession.sql("select document_id, c.sequence_number, c.chunk_type, c.token_count, md5(c.content) as digest from {docs} d, lateral chunk(d.text, d.summary) c", docs=docs)


@query(
    "contextual_chunks",
    f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from {{documents}})
      select doc_id, i as line_no, md5(concat_ws(chr(10), case when doc_id % 2 = 0 then 'Document Summary: ' || substr('About ' || doc_id, 1, 300) end, case when i % 3 = 0 then 'Section: part ' || (i // 10) end)
        || case when doc_id % 2 = 0 or i % 3 = 0 then chr(10) || chr(10) else '' end || line) as digest from l""",
)
def contextual_chunks(t):
    rows = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("line_no", (F.col("i") + 1).cast("long"))
    summary = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("About "), F.col("doc_id").cast("string")))
    heading = F.when(F.col("line_no") % 3 == 0, F.concat(F.lit("part "), F.expr("line_no div 10").cast("string")))
    return rows.select("doc_id", "line_no", F.md5(chunking.with_context(F.col("line"), summary, F.lit(None).cast("string"), heading)).alias("digest"))


LINES = """lines as (select doc_id as document_id, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as line_no from {documents}),
  marked as (select document_id, line_no, case when line_no % 5 = 0 then '## ' || raw when line_no % 7 in (3, 4) then '| ' || raw || ' |' else raw end as line from lines)"""


def _lines(t):
    rows = t("documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("i", "raw")).withColumn("line_no", (F.col("i") + 1).cast("long"))
    return rows.select("document_id", "line_no", F.when(F.col("line_no") % 5 == 0, F.concat(F.lit("## "), "raw")).when((F.col("line_no") % 7).isin(3, 4), F.concat(F.lit("| "), "raw", F.lit(" |"))).otherwise(F.col("raw")).alias("line"))


@query(
    "heading_segments",
    f"""with {LINES}, s as (select *, cast(sum(cast(regexp_matches(line, '^#{{{{1,6}}}} ') as int)) over (partition by document_id order by line_no) as bigint) as segment from marked)
      select document_id, segment, max(case when regexp_matches(line, '^#{{{{1,6}}}} ') then trim(regexp_replace(line, '^#+ ', '')) end) as heading, md5(coalesce(string_agg(case when not regexp_matches(line, '^#{{{{1,6}}}} ') then line end, chr(10) order by line_no), '')) as digest from s group by 1, 2""".replace("{{{{", "{").replace("}}}}", "}").replace("{{", "{").replace("}}", "}"),
)
def heading_segments(t):
    out = chunking.split_by_headings(_lines(t), chunking.markdown_heading(F.col("line")))
    return out.select("document_id", "segment", "heading", F.md5("content").alias("digest"))


@query(
    "table_runs",
    f"""with {LINES}, k as (select *, line_no - row_number() over (partition by document_id order by line_no) as run from marked where starts_with(trim(line), '|') and ends_with(trim(line), '|') and length(trim(line)) > 1)
      select document_id, min(line_no) as first_line, md5(string_agg(line, chr(10) order by line_no)) as digest from k group by document_id, run""",
)
def table_runs(t):
    return chunking.table_runs(_lines(t)).select("document_id", "first_line", F.md5("content").alias("digest"))


@query("table_remainder", f"with {LINES} select document_id, md5(coalesce(string_agg(line, chr(10) order by line_no) filter (not (starts_with(trim(line), '|') and ends_with(trim(line), '|') and length(trim(line)) > 1)), '')) as digest from marked group by document_id")
def table_remainder(t):
    """What is left of each document once its tables are taken out."""
    return chunking.without_tables(_lines(t)).select("document_id", F.md5("content").alias("digest"))


@query(
    "page_chunks",
    """with l as (select doc_id as document_id, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from {documents}),
      p as (select document_id, i // 10 as page, case when (i // 10) % 3 = 2 then null else string_agg(raw, chr(10) order by i) end as text, case when (i // 10) % 4 = 1 then 'NONE' when (i // 10) % 4 = 2 then 'A picture' end as vision from l group by 1, 2),
      c as (select document_id, page, nullif(trim(coalesce(text, ''), ' '), '') as a, nullif(nullif(trim(coalesce(vision, ''), ' '), ''), 'NONE') as b from p)
      select document_id, page, md5(concat_ws(chr(10) || chr(10), a, b)) as digest, case when a is null then 'image_description' else 'text' end as chunk_type from c where concat_ws('', a, b) <> ''""",
)
def page_chunks(t):
    rows = t("documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("i", "raw")).withColumn("page", F.expr("cast(i div 10 as bigint)"))
    pages = rows.groupBy("document_id", "page").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("i", "raw"))), lambda x: x["raw"])).alias("text"))
    pages = pages.withColumns({"text": F.when(F.col("page") % 3 != 2, F.col("text")), "vision_text": F.when(F.col("page") % 4 == 1, "NONE").when(F.col("page") % 4 == 2, "A picture")})
    return chunking.page_chunks(pages).select("document_id", "page", F.md5("content").alias("digest"), "chunk_type")


@query("global_pages", "with b as (select distinct user_id as document_id, event_id % 9 as batch, 1 + event_id % 9 * 3 as page_count from {events}) select document_id, batch, cast(coalesce(sum(page_count) over (partition by document_id order by batch rows between unbounded preceding and 1 preceding), 0) + 1 as bigint) as first_page from b")
def global_pages(t):
    b = t("events").select(F.col("user_id").alias("document_id"), (F.col("event_id") % 9).alias("batch"), (1 + F.col("event_id") % 9 * 3).alias("page_count")).distinct()
    return chunking.global_pages(b).select("document_id", "batch", "first_page")


@query(
    "slide_chunks",
    """select conv_id as document_id, turn as slide, concat_ws(chr(10), '# ' || role, array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> '' and x <> role), chr(10)), case when turn % 2 = 0 then 'Notes: turn ' || turn end) as content from {conversations}""",
)
def slide_chunks(t):
    rows = t("conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("slide"), F.col("role").alias("title"), F.split("text", "\n").alias("content"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("turn "), F.col("turn").cast("string"))).alias("notes"))
    return chunking.slide_chunks(rows)


_TINY = COUNT.format("x.content") + " < 20"


@query(
    "merged_slides",
    f"""with d as (select conv_id as document_id, list(struct_pack(slide := cast(turn as bigint), content := text) order by turn) as s from {{conversations}} group by conv_id),
      f as (select document_id, list_reduce(s, lambda a, x: case
        when a.slide is not null then struct_pack("out" := list_append(a.out, struct_pack(slide := a.slide, content := a.content || chr(10) || chr(10) || '---' || chr(10) || chr(10) || x.content)), slide := cast(null as bigint), content := cast(null as varchar))
        when {_TINY} then struct_pack("out" := a.out, slide := x.slide, content := x.content)
        else struct_pack("out" := list_append(a.out, x), slide := cast(null as bigint), content := cast(null as varchar)) end,
        struct_pack("out" := cast([] as struct(slide bigint, content varchar)[]), slide := cast(null as bigint), content := cast(null as varchar))) as a from d),
      e as (select document_id, unnest(case when a.slide is not null then list_append(a.out, struct_pack(slide := a.slide, content := a.content)) else a.out end) as x from f)
      select document_id, x.slide as first_slide, x.content as content from e""",
)
def merged_slides(t):
    """Small slides joined to the next."""
    rows = t("conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").cast("long").alias("slide"), F.col("text").alias("content"))
    return chunking.merge_small_slides(rows)


@query("slide_text", "select conv_id as document_id, string_agg('--- Slide ' || turn || ' ---' || chr(10) || text, chr(10) order by turn) as text from {conversations} group by conv_id")
def slide_text(t):
    return chunking.slide_text(t("conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("slide"), F.array("text").alias("content")))


def _sheets(t):
    row = F.struct("s_suppkey", F.array(F.col("s_suppkey").cast("string"), F.col("s_name")).alias("r"))
    rows = t("supplier").groupBy(F.col("s_nationkey").cast("long").alias("document_id")).agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["r"]).alias("rows"))
    return rows.select("document_id", F.lit("suppliers").alias("name"), F.array(F.lit("key"), F.lit("name")).alias("headers"), "rows")


@query(
    "sheet_profiles",
    "select cast(s_nationkey as bigint) as document_id, 'suppliers' as name, count(*) as rows, 'key,name' as columns, array_to_string(list_slice(list(s_suppkey || '|' || s_name order by s_suppkey), 1, 20), chr(10)) as first from {supplier} group by s_nationkey",
)
def sheet_profiles(t):
    return chunking.sheet_profile(_sheets(t))


def _groups(most: int, head: int) -> str:
    """Sheets of suppliers as (document_id, part, g): groups of lines under their header."""
    n = COUNT.format("x")
    return f"""d as (select cast(s_nationkey as bigint) as document_id, list('| ' || s_suppkey || ' | ' || s_name || ' |' order by s_suppkey) as r from {{supplier}} group by s_nationkey),
      f as (select document_id, list_reduce(r, lambda a, x: case when len(a.held) > 0 and a.n + {n} + {head} > {most} then struct_pack("out" := list_append(a.out, a.held), held := [x], n := cast({n} as bigint))
        else struct_pack("out" := a.out, held := list_append(a.held, x), n := cast(a.n + {n} as bigint)) end, struct_pack("out" := cast([] as varchar[][]), held := cast([] as varchar[]), n := cast(0 as bigint))) as a from d),
      g as (select document_id, unnest(list_append(a.out, a.held)) as g, generate_subscripts(list_append(a.out, a.held), 1) - 1 as part from f)"""


@query("sheet_chunks", f"with {_groups(40, 5)} select document_id, 'suppliers' as name, part, '| key | name |' || chr(10) || array_to_string(g, chr(10)) as content from g")
def sheet_chunks(t):
    """Row groups of each sheet under a repeated header."""
    return chunking.sheet_chunks(_sheets(t), 40)


@query(
    "sheet_extras",
    """with d as (select cast(s_nationkey as bigint) as k, count(*) as n from {supplier} group by 1)
      select k as document_id, 'suppliers - by nation' as heading, '[bar] by nation' || chr(10) || 'Categories: a, b' || chr(10) || 'n: ' || cast(cast(n as double) as varchar) as content, 'chart' as chunk_type from d
      union all select k, 'suppliers - named ranges', 'all: A1:B' || n, 'text' from d where k % 2 = 0""",
)
def sheet_extras(t):
    n = F.size("rows").cast("string")
    chart = F.struct(F.lit("bar").alias("kind"), F.lit("by nation").alias("title"), F.array(F.lit("a"), F.lit("b")).alias("categories"), F.array(F.struct(F.lit("n").alias("name"), F.array(F.size("rows").cast("double")).alias("values"))).alias("series"))
    named = F.array(F.struct(F.lit("all").alias("name"), F.concat(F.lit("A1:B"), n).alias("cells")))
    return chunking.sheet_extras(_sheets(t).withColumns({"charts": F.array(chart), "named_ranges": F.when(F.col("document_id") % 2 == 0, named).otherwise(F.slice(named, 1, 0))}))


@query("sheet_text", "with r as (select *, row_number() over (partition by s_nationkey order by s_suppkey) as i from {supplier}) select cast(s_nationkey as bigint) as document_id, '--- Sheet suppliers ---' || chr(10) || 'key | name' || chr(10) || string_agg(s_suppkey || ' | ' || s_name, chr(10) order by i) as text from r where i <= 50 group by s_nationkey")
def sheet_text(t):
    return chunking.sheet_text(_sheets(t))


@query(
    "section_chunks",
    f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from {{documents}}),
      h as (select *, case when i % 6 = 1 then 'Part ' || (i // 6) when i % 6 = 4 then '  Part ' || (i // 6) || ' ' else line end as said, i % 6 in (1, 4) as head from l),
      s as (select *, cast(sum(cast(head as int)) over (partition by doc_id order by i) as bigint) as seg from h),
      g as (select doc_id, seg, trim(string_agg(said, chr(10) order by i), ' ') as body, max(case when head then trim(said) end) as heading from s group by doc_id, seg),
      k as (select doc_id, row_number() over (partition by doc_id order by seg) - 1 as n, heading, body from g where body <> '')
      select doc_id as document_id, n as sequence_number, heading, md5(body) as digest from k""",
)
def section_chunks(t):
    """Segments under known headings (each line of every sixth and fourth of six)."""
    line = F.transform(F.split("text", "\n"), lambda x, i: F.when((i + 1) % 6 == 1, F.concat(F.lit("Part "), F.floor((i + 1) / 6).cast("string"))).when((i + 1) % 6 == 4, F.concat(F.lit("  Part "), F.floor((i + 1) / 6).cast("string"), F.lit(" "))).otherwise(x))
    heads = F.transform(F.sequence(F.lit(0), F.size(F.split("text", "\n"))), lambda i: F.concat(F.lit("Part "), i.cast("string")))
    parts = chunking.section_parts(F.array_join(line, "\n"), heads, most=1_000_000)
    return t("documents").select(F.col("doc_id").alias("document_id"), F.posexplode(parts).alias("n", "c")).select("document_id", F.col("n").cast("long").alias("sequence_number"), "c.heading", F.md5("c.content").alias("digest"))


NESTED = "struct<kind:string,title:string,categories:array<string>,series:array<struct<name:string,values:array<double>>>>"


@query(
    "parsed_chunks",
    f"""with d as (select doc_id, doc_id % 6 as k, lower(text) as w, text, case when doc_id % 4 = 0 then 'About ' || doc_id end as summary from {{documents}}),
      c as (select doc_id, summary, 0 as n, case k when 0 then '# Deck' || chr(10) || 'line ' || doc_id || chr(10) || 'Notes: n' when 1 then '| a | b |' || chr(10) || '| 1 | ' || doc_id || ' |' when 3 then 'page ' || doc_id when 2 then 'Intro' || chr(10) || 'x ' || doc_id else 'plain ' || doc_id end as content,
          case k when 0 then 'Deck' when 1 then 'S' when 2 then 'Intro' end as heading, case k when 1 then 'table' when 3 then 'image_description' else 'text' end as chunk_type from d
        union all select doc_id, summary, 1, 'End' || chr(10) || 'y', 'End', 'text' from d where k = 2),
      f as (select *, concat_ws(chr(10), 'Document Summary: ' || summary, case when heading = 'S' then 'Sheet Summary: sums' end, 'Section: ' || heading) as prefix from c)
      select doc_id as document_id, n as sequence_number, heading, chunk_type, case when prefix <> '' then prefix || chr(10) || chr(10) else '' end || content as content_with_context from f
      union all select doc_id, -1, null, 'summary', 'Document Summary: ' || summary from d where summary is not null""",
)
def parsed_chunks(t):
    """Documents of six kinds through the dispatch by file type."""
    d = F.col("doc_id")
    own = d.cast("string")
    charts = F.array().cast(f"array<{NESTED}>")
    slides = F.array(F.struct(F.lit("Deck").alias("title"), F.array(F.lit("Deck"), F.concat(F.lit("line "), own)).alias("content"), F.lit("n").alias("notes"), charts.alias("charts")))
    sheets = F.array(F.struct(F.lit("S").alias("name"), F.array(F.lit("a"), F.lit("b")).alias("headers"), F.array(F.array(F.lit("1"), own)).alias("rows")))
    pages = F.array(F.struct(F.lit(" ").alias("text"), F.concat(F.lit("page "), own).alias("vision_text")), F.struct(F.lit("").alias("text"), F.lit("NONE").alias("vision_text")))
    said = F.when(d % 6 == 2, F.concat(F.lit("Intro\nx "), own, F.lit("\nEnd\ny"))).otherwise(F.concat(F.lit("plain "), own))
    rows = t("documents").select(
        d.alias("document_id"), F.element_at(F.array(*map(F.lit, ["pptx", "xlsx", "docx", "pdf", "txt", "pptx"])), (d % 6 + 1).cast("int")).alias("file_type"), said.alias("text"), F.when(d % 4 == 0, F.concat(F.lit("About "), own)).alias("summary"),
        F.array(F.lit("Intro"), F.lit("End")).alias("headings"), pages.alias("pages"), F.when(d % 6 == 0, slides).alias("slides"), sheets.alias("sheets"), F.create_map(F.lit("S"), F.lit("sums")).alias("section_summaries"),
    )
    return chunking.chunk_parsed(rows).select("document_id", "sequence_number", "heading", "chunk_type", "content_with_context")


@query("sentences", "select doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: x <> '')) as n from {documents}")
def sentences(t):
    return t("documents").select("doc_id", F.size(chunking.sentences(F.col("text"))).cast("long").alias("n"))


PLACES = "list_transform(list_filter(regexp_split_to_array(lower(x), '[^a-z]+'), lambda y: y <> ''), lambda w: cast('0x' || substr(md5(w), 1, 4) as bigint) % 32)"
SIMILAR = f"""t as (select doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: x <> '') as s from {{documents}}),
  v as (select doc_id, unnest(list_transform(s, lambda x: {PLACES})) as p, generate_subscripts(s, 1) - 1 as sentence from t),
  h as (select doc_id, sentence, list_transform(range(32), lambda i: cast(len(list_filter(p, lambda y: y = i)) as double)) as e from v),
  n as (select doc_id, sentence, e, lead(e) over (partition by doc_id order by sentence) as f from h),
  near as (select doc_id as document_id, sentence, case when f is not null and list_sum(e) > 0 and list_sum(f) > 0 then round(list_cosine_similarity(e, f), 6) end as similarity from n)"""


@query("sentence_pairs", f"with {SIMILAR} select * from near")
def sentence_pairs(t):
    return chunking.sentence_pairs(t("documents").select(F.col("doc_id").alias("document_id"), "text"))


@query(
    "topic_segments",
    f"""with {SIMILAR}, c as (select *, coalesce(cast(similarity < 0.35 and sentence + 1 >= 3 and count(*) over (partition by document_id) >= 6 as int), 0) as cut from near)
      select document_id, sentence, cast(coalesce(sum(cut) over (partition by document_id order by sentence rows between unbounded preceding and 1 preceding), 0) as bigint) as segment from c""",
)
def topic_segments(t):
    """Topic boundaries between sentences, by the default embeddings."""
    rows = chunking.sentence_pairs(t("documents").select(F.col("doc_id").alias("document_id"), "text"))
    return chunking.topic_boundaries(rows, 0.35).select("document_id", "sentence", "segment")


@query("window_summaries", f"select doc_id, split_part(text, '.', 1) as lead from {{documents}}")
def window_summaries(t):
    return t("documents").select("doc_id", metrics.lead_sentence(F.col("text")).alias("lead"))


@query(
    "sheet_parts",
    f"""with {_groups(40, 5)}, m as (select *, count(*) over (partition by document_id) as many from g)
      select document_id, case when many > 1 then 'suppliers (part ' || (part + 1) || ')' else 'suppliers' end as heading, part, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || array_to_string(g, chr(10)) as content from m""",
)
def sheet_parts(t):
    """Row groups of sheets in the numbered form."""
    return chunking.sheet_parts(_sheets(t), 20)


_JOINED = "a.held.content || chr(10) || chr(10) || x.heading || chr(10) || x.content"


@query(
    "merged_sections",
    f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from {{documents}}),
      d as (select doc_id, list(struct_pack(heading := 'h' || i, "level" := cast(1 + (i // 3) % 2 as int), content := content) order by i) as s from l group by doc_id),
      f as (select doc_id, list_reduce(s[2:], lambda a, x: case when {COUNT.format('a.held.content')} < 225 and a.held.level = x.level and {COUNT.format(_JOINED)} <= 600
          then struct_pack("out" := a.out, held := struct_pack(heading := a.held.heading, "level" := a.held.level, content := {_JOINED}))
          else struct_pack("out" := list_append(a.out, a.held), held := x) end, struct_pack("out" := cast([] as struct(heading varchar, "level" int, content varchar)[]), held := s[1])) as a from d),
      e as (select doc_id, unnest(list_append(a.out, a.held)) as x, generate_subscripts(list_append(a.out, a.held), 1) - 1 as n from f)
      select doc_id as document_id, n as sequence_number, x.heading as heading, md5(x.content) as digest from e where x.content <> ''""",
)
def merged_sections(t):
    """Lines of every document as sections; small ones join the next of their level."""
    line = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.concat(F.lit("h"), i.cast("string")).alias("heading"), (1 + F.floor(i / 3) % 2).cast("int").alias("level"), x.alias("content")))
    return chunking.merge_small_sections(t("documents").select(F.col("doc_id").alias("document_id"), line.alias("sections"))).select("document_id", "sequence_number", "heading", F.md5("content").alias("digest"))


@query("doc_specs", "select event_id, case when event_id % 3 = 0 then try_cast(json_extract_string(props, '$.k') as bigint) end as k from {events}")
def doc_specs(t):
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Here: <doc_spec>"), "props", F.lit("</doc_spec> done"))).otherwise(F.col("props"))
    return t("events").select("event_id", text.doc_spec(said, "k bigint")["k"].alias("k"))


@query(
    "filter_departments",
    f"with {TITLES} select doc_id, coalesce(case when doc_id % 5 = 0 then 'general' end, named, case when doc_id % 2 = 0 then 'sales' end) as department from titles",
)
def filter_departments(t):
    own = F.when(F.col("doc_id") % 5 == 0, "general")
    return _titles(t).select("doc_id", text.filter_department(own, F.col("q"), F.when(F.col("doc_id") % 2 == 0, "sales")).alias("department"))


@query("filled_gaps", "select doc_id, coalesce(case when doc_id % 3 <> 0 then source end, 'derived ' || length(text)) as department, coalesce(case when doc_id % 2 = 0 then lang end, 'xx') as language from {documents}")
def filled_gaps(t):
    """Missing department and language from what a model says of the text."""
    rows = t("documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("department"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("language"))
    model = lambda ts: [{"department": f"derived {len(x)}", "language": "xx"} for x in ts]
    return hooks.fill_gaps(rows, model, ["department", "language"]).drop("text")


@query(
    "merged_pages",
    """with l as (select doc_id, substr(text, 1, 40) as a, case doc_id % 3 when 0 then '# ' || substr(text, 1, 20) when 1 then '' end as b, case doc_id % 4 when 0 then ' NONE ' when 1 then 'a chart' when 2 then '' end as c, doc_id % 5 < 2 as visual from {documents})
      select doc_id, md5(case when visual then concat_ws(chr(10) || chr(10), nullif(a, ''), nullif(nullif(trim(coalesce(c, ''), ' '), 'NONE'), '')) else coalesce(nullif(b, ''), a, '') end) as digest from l""",
)
def merged_pages(t):
    """Text of pages from the parser, an extraction service and what vision saw."""
    n = F.col("doc_id")
    parsed, start = F.substring("text", 1, 40), F.concat(F.lit("# "), F.substring("text", 1, 20))
    extracted = F.when(n % 3 == 0, start).when(n % 3 == 1, "")
    vision = F.when(n % 4 == 0, " NONE ").when(n % 4 == 1, "a chart").when(n % 4 == 2, "")
    return t("documents").select("doc_id", F.md5(chunking.page_merge(parsed, extracted, vision, n % 5 < 2)).alias("digest"))
