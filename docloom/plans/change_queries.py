"""Queries of the change feed, permissions, integrity checks and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions.text import entity_name, file_extension, last_folder
from docloom.operators import access, changes, checks, conversations, metrics
from docloom.plans.registry import query
from docloom.sources import files
from docloom.sources.scratch import scratch_path

LAST = "lastf as (select * from (select *, row_number() over (partition by drive_id, item_id order by modified_at desc, position desc) as rn from {feed}) where rn = 1)"
EXT = "case when contains(f.name, '.') then lower(split_part(f.name, '.', -1)) else '' end"
CLASS = f"""classified as (select f.*, case when f.is_deleted then case when s.item_id is not null then 'DELETED' end
  when f.is_folder or {EXT} not in ('pptx', 'docx', 'pdf', 'xlsx') then null when s.item_id is null then 'CREATED'
  when f.ctag is not null and f.ctag <> '' and coalesce(s.ctag, '') <> f.ctag then 'UPDATED' when f.etag is not null and f.etag <> '' and coalesce(s.etag, '') <> f.etag then 'PERMISSION_CHANGED' end as change
  from lastf f left join (select * from {{stored}} where status <> 'deleted') s on s.item_id = f.item_id and s.drive_id = f.drive_id)"""


def _long(df, *cols):
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


def _classified(t):
    return changes.classify(changes.last_per_key(t("feed")), t("stored"))


@query("classified_changes", f"with {LAST}, {CLASS} select drive_id, item_id, change from classified")
def classified_changes(t):
    return _classified(t).select("drive_id", "item_id", "change")


@query(
    "change_stats",
    f"""with {LAST}, {CLASS} select drive_id, count(*) filter (change = 'CREATED') as created, count(*) filter (change = 'UPDATED') as updated, count(*) filter (change = 'DELETED') as deleted,
      count(*) filter (change = 'PERMISSION_CHANGED') as permission_changed, count(*) filter (change is null) as skipped from classified group by drive_id""",
)
def change_stats(t):
    return changes.change_stats(_classified(t))


def applied(changes: str, stored: str, old: bool) -> str:
    """SQL of the snapshot after classified ``changes``; ``old``: stored rows have the
    columns that items bring."""
    write, fresh = "n.change in ('CREATED', 'UPDATED')", "(n.change = 'CREATED' or s.status is null)"
    was = lambda c: f"s.{c}" if old else "null"
    items = [f"case when {write} then coalesce(n.{c}, {was(c)}) else {was(c)} end as {c}" for c in ("name", "size", "url", "modified_at")]
    items.append(f"case when {write} or n.change = 'PERMISSION_CHANGED' then coalesce(n.modified_by, {was('modified_by')}) else {was('modified_by')} end as modified_by")
    items += [f"case when {write} and {fresh} then coalesce(n.{c}, {was(c)}) else {was(c)} end as {c}" for c in ("mime_type", "parent_path", "created_by")]
    return f"""select drive_id, item_id, case when {write} then coalesce(n.ctag, s.ctag) else s.ctag end as ctag, case when {write} or n.change = 'PERMISSION_CHANGED' then coalesce(n.etag, s.etag) else s.etag end as etag,
      case when {write} then 'pending' when n.change = 'DELETED' then 'deleted' else s.status end as status, cast(case when {write} then 0 else s.retry_count end as bigint) as retry_count, {', '.join(items)}
      from {stored} s full outer join (select * from {changes} where change is not null) n using (drive_id, item_id)"""


@query("next_snapshot", f"with {LAST}, {CLASS} {applied('classified', '{stored}', False)}")
def next_snapshot(t):
    """Create, update, delete and permission change in one full outer join."""
    return changes.apply(t("stored").drop("content_hash"), _classified(t))


@query(
    "filtered_changes",
    f"with {LAST}, {CLASS} select drive_id, item_id, case when change = 'DELETED' or contains(lower(parent_path), 'finance') and not contains(lower(parent_path), 'reports') or contains(lower(parent_path), 'hr') then change end as change from classified",
)
def filtered_changes(t):
    """The path filter holds back creates and updates, never deletes."""
    rows = changes.classify(changes.last_per_key(t("feed")), t("stored"), include=["Finance", "HR"], exclude=["reports"])
    return rows.select("drive_id", "item_id", "change")


@query("keyed_changes", f"with two as (select *, case when item_id % 2 = 0 then 'main' else 'care' end as kb from {{feed}}), {LAST.replace('{feed}', 'two')}, {CLASS} select kb, drive_id, item_id, case when change in ('UPDATED', 'PERMISSION_CHANGED') and kb = 'care' then 'CREATED' when kb = 'care' and is_deleted then null when kb = 'care' and change is null and not is_folder and lower(split_part(name, '.', -1)) in ('pptx', 'docx', 'pdf', 'xlsx') and contains(name, '.') then 'CREATED' else change end as change from classified")
def keyed_changes(t):
    """Documents of another knowledge base are other documents: the second has none."""
    kb = F.when(F.col("item_id") % 2 == 0, "main").otherwise("care")
    return changes.classify(changes.last_per_key(t("feed").withColumn("kb", kb)), t("stored").withColumn("kb", F.lit("main"))).select("kb", "drive_id", "item_id", "change")


@query(
    "limited_changes",
    f"""with {LAST}, {CLASS}, k as (select *, row_number() over (partition by drive_id, change = 'DELETED' order by position) as n from classified where change is not null)
      select drive_id, item_id, change, change = 'DELETED' or n <= 50 as dispatched from k""",
)
def limited_changes(t):
    return changes.limit_changes(_classified(t), 50, ["drive_id"]).select("drive_id", "item_id", "change", "dispatched")


@query(
    "replay_flags",
    f"""with {LAST}, {CLASS}, k as (select *, row_number() over (partition by drive_id, change = 'DELETED' order by position) as n from classified where change is not null)
      select drive_id, bool_or(not (change = 'DELETED' or n <= 50)) as reset_cursor from k group by drive_id""",
)
def replay_flags(t):
    return changes.replay_flag(changes.limit_changes(_classified(t), 50, ["drive_id"]))


@query("filtered_paths", "select position from {feed} where (contains(lower(parent_path), 'finance') or contains(lower(parent_path), 'hr')) and not contains(lower(parent_path), 'reports')")
def filtered_paths(t):
    return t("feed").where(changes.path_allowed(F.col("parent_path"), ["Finance", "HR"], ["reports"])).select("position")


LISTING = "listing as (select * from {feed} where item_id % 6 <> 0 and drive_id <> 2)"


@query("orphans", f"with {LISTING} select drive_id, item_id from {{stored}} s where status <> 'deleted' and not exists (select 1 from listing l where l.drive_id = s.drive_id and l.item_id = s.item_id)")
def orphans(t):
    return changes.orphans(t("stored"), t("feed").where("item_id % 6 <> 0 and drive_id <> 2")).select("drive_id", "item_id")


@query(
    "reconciliation",
    f"""with lastf as (select * from (select *, row_number() over (partition by drive_id, item_id order by modified_at desc, position desc) as rn from {{feed}} where item_id % 6 <> 0) where rn = 1), {CLASS}
      select drive_id, item_id, change from classified where change is not null union all
      select drive_id, item_id, 'DELETED' from {{stored}} s where status <> 'deleted' and not exists (select 1 from {{feed}} l where l.item_id % 6 <> 0 and l.drive_id = s.drive_id and l.item_id = s.item_id)""",
)
def reconciliation(t):
    return changes.reconcile(t("stored"), t("feed").where("item_id % 6 <> 0"))


@query(
    "reconciliation_totals",
    f"""with {LISTING}, i as (select drive_id, count(distinct item_id) as items from listing group by 1), d as (select drive_id, count(*) as documents from {{stored}} where status <> 'deleted' group by 1),
      o as (select drive_id, count(*) as orphans from {{stored}} s where status <> 'deleted' and not exists (select 1 from listing l where l.drive_id = s.drive_id and l.item_id = s.item_id) group by 1)
      select drive_id, coalesce(items, 0) as items, coalesce(documents, 0) as documents, coalesce(orphans, 0) as orphans from i full outer join d using (drive_id) full outer join o using (drive_id)""",
)
def reconciliation_totals(t):
    return changes.reconcile_totals(t("stored"), t("feed").where("item_id % 6 <> 0 and drive_id <> 2"))


@query(
    "unchanged_gate",
    """select f.position from {feed} f left join (select * from {stored} where status = 'completed') s on s.drive_id = f.drive_id and s.item_id = f.item_id
      where s.content_hash is null or s.content_hash <> cast(f.position % 17 as varchar)""",
)
def unchanged_gate(t):
    incoming = t("feed").withColumn("content_hash", (F.col("position") % 17).cast("string"))
    return changes.unchanged_gate(incoming, t("stored")).select("position")


@query("retry_selection", "select drive_id, item_id, 'pending' as status, retry_count from {stored} where status = 'failed' and retry_count < 3")
def retry_selection(t):
    return changes.retry_selection(t("stored")).select("drive_id", "item_id", "status", "retry_count")


@query("failure_records", "select event_id, 'failed' as status, substr(props, 1, 5) as error_message, event_id % 5 + 1 as retry_count from {events} where event_type = 'error'")
def failure_records(t):
    rows = t("events").where("event_type = 'error'").select("event_id", F.substring("props", 1, 5).alias("error"), (F.col("event_id") % 5).alias("retry_count"))
    return changes.failure_record(rows)


@query("next_attempts", "select event_id, cast(ts as timestamp) + to_seconds(cast(60 * pow(2, event_id % 5) as integer)) as due_at from {events} where event_type = 'error' and event_id % 5 < 3")
def next_attempts(t):
    rows = t("events").where("event_type = 'error'").select("event_id", (F.col("event_id") % 5).alias("retry_count"), F.col("ts").cast("timestamp").alias("failed_at"))
    return changes.next_attempt(rows).select("event_id", F.col("due_at").cast("timestamp_ntz").alias("due_at"))


CURSORS = "cur as (select n_nationkey as drive_id, case when n_nationkey % 5 = 0 then null else 'token' || n_nationkey end as delta_token, timestamp '2024-01-31 00:00:00' - to_days(cast(n_nationkey * 2 as integer)) as token_obtained_at, n_nationkey * 10 as items_processed from nation)"


def _cursors(t):
    n = F.col("n_nationkey")
    at = F.lit("2024-01-31").cast("timestamp") - F.make_interval(days=(n * 2).cast("int"))
    return t("nation").select(n.cast("long").alias("drive_id"), F.when(n % 5 != 0, F.concat(F.lit("token"), n.cast("string"))).alias("delta_token"), at.cast("timestamp").alias("token_obtained_at"), (n * 10).cast("long").alias("items_processed"))


@query("crawl_modes", f"with {CURSORS} select cast(drive_id as bigint) as drive_id, case when delta_token is null or token_obtained_at < timestamp '2024-01-06 00:00:00' then 'full' else 'delta' end as mode from cur")
def crawl_modes(t):
    return changes.crawl_mode(_cursors(t), F.lit("2024-01-31").cast("timestamp")).select("drive_id", "mode")


@query(
    "advanced_cursors",
    f"""with {CURSORS}, runs as (select item_id % 30 as drive_id, 'new' || (item_id % 30) as new_token, count(*) as items from {{feed}} group by 1, 2)
      select cast(drive_id as bigint) as drive_id, coalesce(new_token, delta_token) as delta_token, cast(coalesce(items_processed, 0) + coalesce(items, 0) as bigint) as items_processed,
        case when items is not null then timestamp '2024-01-31 00:00:00' when drive_id is not null then timestamp '2024-01-01 00:00:00' end as last_sync_at,
        case when items is not null and drive_id % 2 = 0 then timestamp '2024-01-31 00:00:00' when items_processed is not null then timestamp '2023-12-01 00:00:00' end as full_crawl_at from cur full outer join runs using (drive_id)""",
)
def advanced_cursors(t):
    day = lambda d: F.lit(d).cast("timestamp")
    cursors = _cursors(t).withColumns({"last_sync_at": day("2024-01-01"), "full_crawl_at": day("2023-12-01")})
    key = F.col("item_id") % 30
    runs = t("feed").groupBy(key.alias("drive_id")).agg(F.count("*").alias("items")).withColumns({"new_token": F.concat(F.lit("new"), F.col("drive_id").cast("string")), "run_at": day("2024-01-31"), "was_full": F.col("drive_id") % 2 == 0})
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return changes.advance_cursors(cursors, runs).select("drive_id", "delta_token", "items_processed", ntz("last_sync_at"), ntz("full_crawl_at"))


@query("audit_events", f"with {LAST}, {CLASS} select drive_id, item_id, change as change_type, name as file_name, case when item_id % 4 = 0 then 'boom ' || item_id end as error from classified where change is not null")
def audit_events(t):
    failed = F.when(F.col("item_id") % 4 == 0, F.concat(F.lit("boom "), F.col("item_id").cast("string")))
    return changes.audit(_classified(t).withColumn("error", failed), F.lit("2024-01-31").cast("timestamp")).select("drive_id", "item_id", "change_type", "file_name", "error")


@query("cascade_delete", "select chunk_id, document_id from {chunks} where document_id not in (select document_id from {doc_status} where status = 'deleted')")
def cascade_delete(t):
    return changes.delete_documents(t("chunks").select("chunk_id", "document_id"), t("doc_status").where("status = 'deleted'"))


@query("feed_names", "select position, case when contains(name, '.') then lower(split_part(name, '.', -1)) else '' end as extension, list_filter(string_split(split_part(parent_path, ':', -1), '/'), lambda x: x <> '')[-1] as folder from {feed}")
def feed_names(t):
    return t("feed").select("position", file_extension(F.col("name")).alias("extension"), last_folder(F.col("parent_path")).alias("folder"))


# ---- permissions -----------------------------------------------------------


@query(
    "grant_rows",
    """select event_id as document_id, 'user' as principal_type, cast(user_id as varchar) as principal_id, case when event_type = 'view' then 'write' else 'read' end as role from {events}
      union all select event_id, 'group', cast(user_id as varchar), case when event_type = 'view' then 'write' else 'read' end from {events} where event_id % 3 = 0
      union all select event_id, 'site_user', 'site' || user_id, case when event_type = 'view' then 'write' else 'read' end from {events} where event_id % 5 = 0""",
)
def grant_rows(t):
    who = F.struct(F.col("user_id").cast("string").alias("user"), F.when(F.col("event_id") % 3 == 0, F.col("user_id").cast("string")).alias("group"), F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("site"), F.col("user_id").cast("string"))).alias("siteUser"))
    none = F.when(F.lit(False), who)
    v2 = F.when(F.col("event_id") % 2 == 0, who).otherwise(none)
    grant = F.struct(F.when(F.col("event_type") == "view", F.array(F.lit("write"))).otherwise(F.array().cast("array<string>")).alias("roles"), v2.alias("grantedToV2"), who.alias("grantedTo"))
    return access.grant_rows(t("events").select(F.col("event_id").alias("document_id"), F.array(grant).alias("grants")))


@query("group_closure", "with recursive c as (select parent as ancestor, child as member from {group_edges} union select c.ancestor, e.child from c join {group_edges} e on e.parent = c.member) select ancestor, member from c")
def group_closure(t):
    return access.expand_groups(t("group_edges"))


@query(
    "access_pairs",
    """with recursive c as (select parent as ancestor, child as member from {group_edges} union select c.ancestor, e.child from c join {group_edges} e on e.parent = c.member),
      g as (select distinct cast(floor(event_id / 200) as bigint) as document_id, user_id from {events})
      select document_id, user_id from g union select document_id, member from g join c on c.ancestor = g.user_id""",
)
def access_pairs(t):
    e = t("events").select(F.expr("event_id div 200").alias("document_id"), "user_id")
    grants = e.select("document_id", F.lit("user").alias("principal_type"), F.col("user_id").alias("principal_id")).unionByName(e.select("document_id", F.lit("group").alias("principal_type"), F.col("user_id").alias("principal_id")))
    return access.access_pairs(grants, access.expand_groups(t("group_edges")))


@query("rebuilt_access", "select user_id, document_id from {access} where document_id % 3 <> 0 union all select distinct user_id % 10, document_id from {access} where document_id % 3 = 0")
def rebuilt_access(t):
    touched = t("access").where("document_id % 3 = 0")
    new = touched.select("document_id", (F.col("user_id") % 10).alias("user_id")).distinct()
    return access.rebuild_access(t("access"), touched, new)


@query(
    "refreshed_access",
    """with g as (select distinct user_id % 7 as user_id, document_id from {access}) select user_id, document_id from {access} where document_id not in (select document_id from {doc_status} where status = 'completed')
      union all select user_id, document_id from g where document_id in (select document_id from {doc_status} where status = 'completed')""",
)
def refreshed_access(t):
    """All completed documents' pairs, rebuilt from their grants."""
    grants = t("access").select("document_id", F.lit("user").alias("principal_type"), (F.col("user_id") % 7).alias("principal_id"))
    return access.refresh_completed(t("doc_status"), grants, t("group_edges").select(F.col("parent").alias("ancestor"), F.col("child").alias("member")), t("access"))


@query("user_documents", "select user_id, array_to_string(list_sort(list(distinct document_id)), ',') as documents from {access} group by user_id")
def user_documents(t):
    return access.documents_of_users(t("access")).withColumn("documents", F.concat_ws(",", F.transform("documents", lambda x: x.cast("string"))))


# ---- checks ----------------------------------------------------------------


@query("repeated_keys", "select drive_id, item_id, count(*) as n from {feed} group by 1, 2 having count(*) > 1")
def repeated_keys(t):
    return checks.repeated_keys(t("feed"), ["drive_id", "item_id"])


@query("dangling_mentions", "select document_id, entity_id from {mentions} where document_id not in (select distinct document_id from {chunks})")
def dangling_mentions(t):
    return checks.dangling(t("mentions").select("document_id", "entity_id"), t("chunks"), "document_id")


@query("outside_domain", "select event_id, event_type from {events} where event_type is null or event_type not in ('view', 'purchase', 'error')")
def outside_domain(t):
    return checks.outside_domain(t("events").select("event_id", "event_type"), "event_type", ["view", "purchase", "error"])


@query("bad_vectors", "select vec_id from {embeddings} where vec_id % 97 in (1, 2, 3, 4, 5)")
def bad_vectors(t):
    """Planted: null, short, with a null, a NaN and an infinite part."""
    e = F.col("embedding").cast("array<double>")
    put = lambda x: F.concat(F.slice(e, 1, 63), F.array(x))
    k = F.col("vec_id") % 97
    bad = F.when(k == 2, F.slice(e, 1, 63)).when(k == 3, put(F.lit(None).cast("double"))).when(k == 4, put(F.lit(float("nan")))).when(k == 5, put(F.lit(float("inf")))).when(k != 1, e)
    return checks.bad_vectors(t("embeddings").withColumn("embedding", bad), "embedding", 64).select("vec_id")


@query("null_counts", "select count(*) filter (ctag is null) as ctag, count(*) filter (etag is null) as etag, count(*) filter (name is null) as name from {feed}")
def null_counts(t):
    return checks.nulls(t("feed"), ["ctag", "etag", "name"])


# ---- metrics ---------------------------------------------------------------


def _start(df):
    return df.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("rates", "select time_bucket(interval '5 minutes', seen_at) as start, department, count(*) as n, round(count(*) / 300, 6) as rate from {metrics} group by 1, 2")
def rates(t):
    return _start(metrics.rates(t("metrics"), "department"))


@query("ratios", "select time_bucket(interval '10 minutes', seen_at) as start, round(avg(cast(department = 'view' as int)), 6) as ratio, count(*) as n from {metrics} group by 1")
def ratios(t):
    return _start(metrics.ratio(t("metrics"), F.col("department") == "view"))


@query("latency_quantiles", "select time_bucket(interval '5 minutes', seen_at) as start, round(quantile_cont(latency, 0.5), 6) as p50, round(quantile_cont(latency, 0.95), 6) as p95, round(quantile_cont(latency, 0.99), 6) as p99 from {metrics} group by 1")
def latency_quantiles(t):
    return _start(metrics.latency_quantiles(t("metrics")))


@query("sliding_rates", "select time_bucket(interval '1 minute', seen_at) - to_minutes(m) as start, count(*) as n from {metrics}, range(0, 5) r(m) group by 1")
def sliding_rates(t):
    return _start(metrics.sliding_rates(t("metrics")))


@query(
    "held_alerts",
    """with p as (select *, row_number() over (partition by department order by event_id) as k from {metrics}), h as (select *, k - row_number() over (partition by department order by event_id) as island from p where latency > 20)
      select department, min(event_id) as first, max(event_id) as last, count(*) as n from h group by department, island having count(*) >= 3""",
)
def held_alerts(t):
    return metrics.held_alerts(t("metrics"), "department", "event_id", F.col("latency") > 20, 3)


@query(
    "alerts_by_span",
    """with p as (select department, seen_at as seen, coalesce(latency > 20, false) as ok from {metrics}),
      g as (select *, lag(ok) over w as ok0, lag(seen) over w as seen0 from p window w as (partition by department order by seen, ok)),
      i as (select *, sum(case when ok and not (coalesce(ok0, false) and seen <= seen0 + interval '90 minutes') then 1 else 0 end) over (partition by department order by seen, ok rows unbounded preceding) as island from g),
      s as (select *, min(seen) over (partition by department, island) as first from i where ok)
      select department, first, max(seen) as last, min(case when seen >= first + interval '2 hours' then seen end) as fired_at, count(*) as n from s group by department, island, first having max(seen) >= first + interval '2 hours'""",
)
def alerts_by_span(t):
    """Alerts held for two hours, however many points that is: points are uneven."""
    out = metrics.held_for(t("metrics"), "department", "seen_at", F.col("latency") > 20, "2 hours", "90 minutes")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first", "last", "fired_at")})


@query(
    "rolled_up_quantiles",
    """with w as (select 'hour' as width, time_bucket(interval '1 hour', seen_at) as start, latency from {metrics} union all select 'day', time_bucket(interval '1 day', seen_at), latency from {metrics})
      select width, start, count(latency) as n, true as within from w group by 1, 2""",
)
def rolled_up_quantiles(t):
    """Quantiles of hours and days from five-minute sketches alone: whether the rank of each,
    counted over all events, is within the sketch's stated error."""
    rows, asked = t("metrics"), {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    hours = metrics.rolled_up(metrics.latency_sketch(rows), "1 hour")
    out = None
    for width, sketches in (("hour", hours), ("day", metrics.rolled_up(hours, "1 day"))):
        q = metrics.sketched_quantiles(sketches, asked)
        seen = rows.where("latency is not null").select(F.window("seen_at", f"1 {width}")["start"].alias("s"), "latency")
        # shares of events below and not above each quantile; its true rank is between them
        share = lambda test: F.avg(test.cast("int"))
        ranks = seen.join(q, F.col("s") == F.col("start")).groupBy("start", "n").agg(*[f(F.col("latency"), F.col(c)).alias(f"{c}_{k}") for c in asked for k, f in (("low", lambda x, y: share(x < y)), ("high", lambda x, y: share(x <= y)))])
        ok = F.lit(True)
        for c, p in asked.items():
            ok &= (F.col(f"{c}_low") <= p + metrics.RANK_ERROR) & (F.col(f"{c}_high") >= p - metrics.RANK_ERROR)
        part = ranks.select(F.lit(width).alias("width"), F.col("start").cast("timestamp_ntz").alias("start"), "n", ok.alias("within"))
        out = part if out is None else out.unionByName(part)
    return out


@query("enumerated_items", "select distinct drive_id, item_id from {feed} where not is_folder and not is_deleted and regexp_matches(lower(name), '[.](pptx|docx|pdf|xlsx|xlsb)$')")
def enumerated_items(t):
    """All supported files of every drive."""
    return files.drive_items(t("feed"))


SERIES = "ser as (select year(o_orderdate) as y, o_orderpriority as label, round(sum(o_totalprice), 2) as v from {orders} group by 1, 2)"


def _series(t):
    return t("orders").groupBy(F.year("o_orderdate").cast("long").alias("y"), F.col("o_orderpriority").alias("label")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))


@query("share_of_total", f"with {SERIES} select y, label, round(sum(v) over (partition by y), 2) as total, round(v / sum(v) over (partition by y), 6) as share from ser")
def share_of_total(t):
    return metrics.share_of_total(_series(t), "v", ["y"]).select("y", "label", "total", "share")


@query(
    "waterfall",
    f"""with {SERIES} select y, label, round(case when row_number() over w = 1 or lead(v) over w is null then 0.0 else coalesce(sum(v) over (partition by y order by label rows between unbounded preceding and 1 preceding), 0.0) end, 2) as base
      from ser window w as (partition by y order by label)""",
)
def waterfall(t):
    return metrics.waterfall(_series(t), "label", "v", ["y"]).select("y", "label", "base")


PRIORITIES = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "unspecified", "5-LOW": "low"}


@query("heat_matrix", f"with {SERIES} select y, " + ", ".join(f"round(sum(v) filter (label = '{k}'), 2) as {n}" for k, n in PRIORITIES.items()) + " from ser group by y")
def heat_matrix(t):
    return metrics.matrix(_series(t), "y", "label", "v", list(PRIORITIES)).withColumnsRenamed(PRIORITIES)


@query(
    "box_statistics",
    """with q as (select o_orderpriority as label, quantile_cont(o_totalprice, 0.25) as a, quantile_cont(o_totalprice, 0.5) as b, quantile_cont(o_totalprice, 0.75) as c from {orders} group by 1)
      select label, round(a, 6) as q1, round(b, 6) as median, round(c, 6) as q3, round(a - 1.5 * (c - a), 6) as low, round(c + 1.5 * (c - a), 6) as high from q""",
)
def box_statistics(t):
    return metrics.box_statistics(t("orders").withColumnRenamed("o_orderpriority", "label"), "label", "o_totalprice")


@query("column_totals", "select round(sum(try_cast(ctag as double)), 2) as ctag, round(sum(try_cast(case when position % 3 = 0 then name when position % 3 = 1 then cast(size as varchar) end as double)), 2) as cell, round(sum(try_cast(name as double)), 2) as name from {feed}")
def column_totals(t):
    """Totals of numbers, of numbers among words, and of words alone."""
    cell = F.when(F.col("position") % 3 == 0, F.col("name")).when(F.col("position") % 3 == 1, F.col("size").cast("string"))
    return metrics.column_totals(t("feed").withColumn("cell", cell), ["ctag", "cell", "name"])


@query("extraction_methods", "select document_id, nullif(count(*) filter (extraction_method = 'ocr'), 0) as ocr_chunks, nullif(count(*) filter (extraction_method = 'native'), 0) as native_chunks, sum(chunk_id % 100) filter (extraction_method = 'ocr') as ocr_tokens, sum(chunk_id % 100) filter (extraction_method = 'native') as native_tokens from {chunks} group by 1")
def extraction_methods(t):
    rows = t("chunks").withColumn("token_count", F.col("chunk_id") % 100)
    return metrics.compare_methods(rows, ["ocr", "native"]).select("document_id", "ocr_chunks", "native_chunks", "ocr_tokens", "native_tokens")


@query(
    "map_reduced",
    """with t as (select doc_id, text, regexp_extract_all(text, '(?:[A-Za-z0-9_\\x{80}-\\x{10FFFF}]+|[!-/:-@\\[-^`{-~])\\s*') as w from {documents}),
      l as (select doc_id, k, split_part(array_to_string(w[k * 200 + 1 : k * 200 + 200], ''), '.', 1) as part from t, range(0, 10000) r(k) where len(w) > 400 and k * 200 < len(w))
      select doc_id, md5('All: ' || string_agg('Section ' || (k + 1) || ': ' || part, chr(10) || chr(10) order by k)) as digest from l group by doc_id
      union all select doc_id, md5(split_part(text, '.', 1)) from t where len(w) <= 400""",
)
def map_reduced(t):
    text = metrics.map_reduce(F.col("text"), metrics.lead_sentence, metrics.lead_sentence, lambda x: F.concat(F.lit("All: "), x), 200, 400)
    return t("documents").select("doc_id", F.md5(text).alias("digest"))


# ---- conversations ---------------------------------------------------------


@query(
    "conversation_history",
    """with r as (select *, row_number() over (partition by conv_id order by turn desc) as k from {conversations})
      select conv_id, string_agg(role || ': ' || substr(text, 1, 200), chr(10) order by turn) as history from r where k > 1 and k <= 11 group by conv_id""",
)
def conversation_history(t):
    return conversations.history_text(t("conversations"))


@query("latest_questions", "select conv_id, arg_max(text, turn) as question from {conversations} where role = 'user' group by conv_id")
def latest_questions(t):
    return conversations.latest_question(t("conversations"))


@query("entity_names", "select doc_id, case when length(n) between 2 and 100 then n end as name from (select doc_id, trim(regexp_replace(substr(text, 1, 60), '[ \\t\\n\\r]+', ' ', 'g')) as n from {documents})")
def entity_names(t):
    return t("documents").select("doc_id", entity_name(F.substring("text", 1, 60)).alias("name"))


@query(
    "landed_pages",
    """select cast(drive_id as varchar) as drive_id, cast(item_id as varchar) as item_id, name, ctag, etag, parent_path, size, url, case when not is_folder then mime_type end as mime_type, created_by, modified_by, is_deleted, is_folder, modified_at from {feed}""",
)
def landed_pages(t):
    """The feed written as JSON change pages of up to 200 items, one a file, and read back."""
    user = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.struct(F.when(F.col("position") % 2 == 0, F.col(c)).alias("email"), F.col(c).alias("displayName")).alias("user")))
    item = F.struct(
        F.col("item_id").cast("string").alias("id"),
        "name",
        F.col("url").alias("webUrl"),
        F.col("ctag").alias("cTag"),
        F.col("etag").alias("eTag"),
        "size",
        F.date_format("modified_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("lastModifiedDateTime"),
        F.struct(F.col("drive_id").cast("string").alias("driveId"), F.col("parent_path").alias("path")).alias("parentReference"),
        user("created_by").alias("createdBy"),
        user("modified_by").alias("lastModifiedBy"),
        F.when(~F.col("is_folder"), F.struct(F.col("mime_type").alias("mimeType"))).alias("file"),
        F.when(F.col("is_folder"), F.struct(F.lit(1).alias("childCount"))).alias("folder"),
        F.when(F.col("is_deleted"), F.struct(F.lit("deleted").alias("state"))).alias("deleted"),
    )
    rows = t("feed")
    pages = rows.groupBy("drive_id", F.floor(F.col("position") / 200).alias("page")).agg(F.collect_list(item).alias("value"))
    landed = files.land(pages.select(F.to_json(F.struct("value")).alias("text")), scratch_path(rows.sparkSession, "pages"))
    columns = ["drive_id", "item_id", "name", "ctag", "etag", "parent_path", "size", "url", "mime_type", "created_by", "modified_by", "is_deleted", "is_folder"]
    return files.feed(rows.sparkSession, landed).select(*columns, F.col("modified_at").cast("timestamp_ntz").alias("modified_at"))


@query("chunk_sink", "select chunk_id, c.document_id, title, department, kb from (select chunk_id, document_id from {chunks}) c join (select document_id, min(title) as title, min(department) as department, case when document_id % 2 = 0 then 'main' else 'care' end as kb from {chunks} group by document_id) d on d.document_id = c.document_id")
def chunk_sink(t):
    """Chunks with their document's columns, appended twice by knowledge base, read back."""
    chunks = t("chunks").select("chunk_id", "document_id")
    docs = t("chunks").groupBy("document_id").agg(F.min("title").alias("title"), F.min("department").alias("department")).withColumn("kb", F.when(F.col("document_id") % 2 == 0, "main").otherwise("care"))
    path = scratch_path(chunks.sparkSession, "sink")
    for part in (0, 1):
        files.write_chunks(chunks.where(F.col("chunk_id") % 2 == part), docs, path)
    return chunks.sparkSession.read.parquet(path)


@query("landed_files", "select sha256(text || chr(10)) as content_hash, cast(strlen(text) + 1 as bigint) as length, count(*) as n, count(*) as ids from {documents} where text is not null group by 1, 2")
def landed_files(t):
    """Every document as a file of its own, listed and fingerprinted; ids differ by path."""
    docs = t("documents").where("text is not null").select("text")
    spark = docs.sparkSession
    found = files.listed(spark, files.land(docs, scratch_path(spark, "files")), ["txt"])
    return found.groupBy("content_hash", "length").agg(F.count("*").alias("n"), F.countDistinct("drive_id", "item_id").alias("ids"))
