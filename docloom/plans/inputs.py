"""Operator inputs derived from the given tables, as SQL that both engines run.

``{name}`` stands for a given table or another input.  In Spark it is bound to a
DataFrame; in the comparison SQL it becomes a common table expression.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: How many chunked documents, feed items and documents with mentions there are: they
#: grow with the tables.
DOCUMENTS = "(select cast(floor(max(vec_id) / 10) as bigint) + 1 from {embeddings})"
ITEMS = "(select cast(floor(count(*) / 25) as bigint) from {events})"
MENTIONING = "(select cast(floor(count(*) / 2) as bigint) from {documents})"
TEXTS = "(select count(*) from {documents})"

INPUTS = {
    "chunks": """select vec_id as chunk_id, cast(floor(vec_id / 10) as bigint) as document_id, embedding,
        case label % 5 when 0 then 'hr' when 1 then 'finance' when 2 then 'sales' when 3 then 'marketing' else 'general' end as department,
        case vec_id % 3 when 0 then 'policy' when 1 then 'report' else 'guide' end as content_type,
        case vec_id % 4 when 0 then 'restricted' when 1 then cast(null as string) else 'public' end as access_level,
        case when vec_id % 2 = 0 then 'main' else 'care' end as kb,
        case vec_id % 2 when 0 then 'ocr' else 'native' end as extraction_method,
        concat('Title ', cast(cast(floor(vec_id / 10) as bigint) as string)) as title,
        concat('https://files.example.org/', cast(cast(floor(vec_id / 10) as bigint) as string)) as url,
        concat('Part ', cast(vec_id % 3 as string)) as heading,
        concat(cast(vec_id % 7 + 1 as string), ',', cast(vec_id % 7 + 2 as string)) as page_numbers,
        vec_id % 7 + 1 as sequence_number,
        case vec_id % 5 when 0 then timestamp '2021-06-01 00:00:00' when 1 then timestamp '2022-01-01 00:00:00' when 2 then timestamp '2023-01-01 00:00:01' else timestamp '2022-07-01 12:00:00' end as created_at
        from {embeddings}""",
    "queries": """select vec_id as query_id, cast(floor(vec_id / 100) as bigint) + 1 as user_id, embedding,
        case cast(floor(vec_id / 100) as bigint) % 5 when 0 then 'cosine' when 1 then 'mmr' when 2 then 'hyde_cosine' when 3 then cast(null as string) else 'none' end as strategy,
        case when vec_id % 200 = 100 then 'finance' else cast(null as string) end as department
        from {embeddings} where vec_id % 100 = 0""",
    "access": f"select distinct user_id, event_id % {DOCUMENTS} as document_id from {{events}} where event_type = 'view'",
    "doc_status": "select distinct document_id, case when document_id % 7 = 0 then 'pending' when document_id % 11 = 0 then 'deleted' else 'completed' end as status from {chunks}",
    "group_edges": "select distinct user_id as parent, user_id * 3 + 1 + event_id % 3 as child from {events}",
    "mentions": f"""select user_id as entity_id, concat('Entity ', cast(user_id as string)) as name, case when user_id % 2 = 0 then 'ORG' else 'PERSON' end as type,
        event_id % {MENTIONING} as document_id, count(*) as n, min(event_id) as first_at from {{events}} where event_type = 'purchase' group by user_id, event_id % {MENTIONING}""",
    "topics": "select doc_id as document_id, source as topic, lang, case when doc_id % 4 = 0 then cast(null as string) when doc_id % 4 = 1 then 'hr' else 'finance' end as department from {documents}",
    "edges": f"""select doc_id as src, lead(doc_id) over (partition by source, lang order by doc_id) as dst, 'SUPERSEDES' as type, cast(null as double) as strength, cast(null as bigint) as count from {{documents}}
        union all select doc_id, doc_id * 7 % {TEXTS}, 'CITES', cast(null as double), cast(null as bigint) from {{documents}}
        union all select doc_id, doc_id * 3 % {TEXTS}, 'RELATED_TO', case when doc_id % 2 = 0 then cast(0.8 as double) end, cast(null as bigint) from {{documents}}
        union all select doc_id, doc_id + 1 + doc_id % 3, 'SHARES_ENTITY', cast(null as double), case when doc_id % 5 = 0 then cast(null as bigint) else doc_id % 12 end from {{documents}} where doc_id % 2 = 0""",
    "feed": f"""select event_id as position, event_id % {ITEMS} as item_id, event_id % 3 as drive_id,
        concat('File ', cast(event_id % {ITEMS} as string), case event_id % {ITEMS} % 5 when 0 then '.pdf' when 1 then '.DOCX' when 2 then '.xlsx' when 3 then '.png' else '' end) as name,
        event_type = 'error' as is_deleted, event_type = 'signup' as is_folder,
        case when event_id % 13 = 0 then cast(null as string) else cast(cast(floor(value) as bigint) as string) end as ctag, cast(round(value, 2) as string) as etag,
        concat('/drives/', cast(event_id % 3 as string), '/root:/', case event_id % 4 when 0 then 'HR' when 1 then 'Finance/Reports' when 2 then 'Sales' else 'Misc' end) as parent_path,
        event_id * 10 as size, concat('https://files.example.org/', cast(event_id % {ITEMS} as string)) as url, case when event_id % 3 = 0 then concat('user', cast(user_id as string)) else cast(null as string) end as modified_by,
        concat('user', cast(user_id as string)) as created_by, case when event_id % {ITEMS} % 5 = 0 then 'application/pdf' else cast(null as string) end as mime_type,
        cast(ts as timestamp) as modified_at from {{events}} where cast(floor(event_id / 400) as bigint) % 2 = 1""",
    "stored": f"""select item_id, drive_id, ctag, etag, status, retry_count, content_hash from (
        select event_id % {ITEMS} as item_id, event_id % 3 as drive_id, cast(cast(floor(value) as bigint) as string) as ctag, cast(round(value, 2) as string) as etag,
        case when event_type = 'error' then 'failed' when event_type = 'signup' then 'deleted' else 'completed' end as status, event_id % 5 as retry_count,
        cast(event_id % 17 as string) as content_hash,
        row_number() over (partition by event_id % {ITEMS}, event_id % 3 order by event_id desc) as rn from {{events}} where cast(floor(event_id / 400) as bigint) % 2 = 0) x where rn = 1 and item_id % 10 <> 9""",
    "judged": "select doc_id % (select cast(floor(count(*) / 5) as bigint) + 1 from {labels}) as query_id, doc_id as rank_key, quality as relevant from {labels}",
    "metrics": "select event_id, cast(ts as timestamp) as seen_at, event_type as department, value as latency, user_id from {events}",
}


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _names(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{([a-z_]+)\}", sql)))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or an input built from given tables."""
    if name in TABLES:
        return tables(spark, sf_dir, name)
    sql = INPUTS[name]
    return spark.sql(sql, **{n: load(spark, sf_dir, n) for n in _names(sql)})


def with_inputs(sql: str) -> str:
    """``sql`` for DuckDB, after the common table expressions of its inputs."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in INPUTS and name not in order:
            for n in _names(INPUTS[name]):
                visit(n)
            order.append(name)

    for n in _names(sql):
        visit(n)
    plain = lambda s: re.sub(r"\{([a-z_]+)\}", r"\1", s)
    body = plain(sql).strip()
    ctes = ", ".join(f"{n} as ({plain(INPUTS[n])})" for n in order)
    if not ctes:
        return body
    if body.lower().startswith("with recursive "):
        return f"with recursive {ctes}, {body[15:]}"
    return f"with {ctes}, {body[5:]}" if body.lower().startswith("with ") else f"with {ctes} {body}"
