"""Permissions: grants to rows, groups to users, rebuilt access pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.sources.scratch import kept


def grant_rows(grants: DataFrame) -> DataFrame:
    """(document_id, principal_type, principal_id, role) of nested grants.

    ``grantedToV2`` wins over ``grantedTo``; user, group and siteUser may all be
    present; the role is the first, else read."""
    g = grants.select("document_id", F.explode("grants").alias("g"))
    to = F.coalesce("g.grantedToV2", "g.grantedTo")
    g = g.select("document_id", F.coalesce(F.try_element_at("g.roles", F.lit(1)), F.lit("read")).alias("role"), to.alias("to"))
    each = F.array(*[F.struct(F.lit(t).alias("principal_type"), F.col(f"to.{f}").alias("principal_id")) for t, f in (("user", "user"), ("group", "group"), ("site_user", "siteUser"))])
    return g.select("document_id", "role", F.explode(each).alias("p")).where("p.principal_id is not null").select("document_id", "p.principal_type", "p.principal_id", "role")


def expand_groups(edges: DataFrame) -> DataFrame:
    """(ancestor, member): transitive closure of (parent, child), cycles allowed.

    Each round joins the newest pairs with the edges and keeps what is new, in a
    written table; it ends when nothing is new."""
    e = edges.select("parent", "child").distinct()
    every = kept(e.select(F.col("parent").alias("ancestor"), F.col("child").alias("member")), "groups")
    new = every
    while not new.isEmpty():
        step = new.join(e, new["member"] == e["parent"]).select("ancestor", F.col("child").alias("member")).distinct()
        new = kept(step.join(every, ["ancestor", "member"], "left_anti"), "groups")
        every = kept(every.unionByName(new), "groups")
    return every


def access_pairs(grants: DataFrame, closure: DataFrame) -> DataFrame:
    """(document_id, user_id): direct grants and members of granted groups.

    ``grants`` holds user and group principals; ``closure`` maps groups to users;
    site users get no pair."""
    direct = grants.where("principal_type = 'user'").select("document_id", F.col("principal_id").alias("user_id"))
    groups = grants.where("principal_type = 'group'").join(closure, grants["principal_id"] == closure["ancestor"]).select("document_id", F.col("member").alias("user_id"))
    return direct.union(groups).distinct()


def rebuild_access(access: DataFrame, touched: DataFrame, new: DataFrame) -> DataFrame:
    """Access after the touched documents' pairs are replaced."""
    old = access.select("document_id", "user_id").join(touched.select("document_id").distinct(), "document_id", "left_anti")
    return old.unionByName(new.select("document_id", "user_id"))


def refresh_completed(documents: DataFrame, grants: DataFrame, closure: DataFrame, access: DataFrame) -> DataFrame:
    """Access after the pairs of all completed documents (document_id, status) are rebuilt
    from their grants."""
    done = documents.where("status = 'completed'").select("document_id").distinct()
    new = access_pairs(grants.join(done, "document_id", "left_semi"), closure)
    return rebuild_access(access, done, new)


def documents_of_users(access: DataFrame) -> DataFrame:
    return access.groupBy("user_id").agg(F.array_sort(F.collect_set("document_id")).alias("documents"))
