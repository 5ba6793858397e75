"""Connected components of a link table, by alternating large and small stars.

Each round is a grouped minimum (pre-aggregated on the map side) and a join, so a
hub with any number of links is never gathered; links inside a class become a star
around its smallest member within a few rounds.  Rounds are written tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from docloom.llm.common import drop_written, written


def _large(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest one."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(links: DataFrame) -> DataFrame:
    """The smaller neighbours of a node, and it, are linked to the smallest.

    Here ``a`` is the larger end of each link."""
    least = links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
    inner = links.join(least, F.col("a") == F.col("n")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return inner.unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable; only nodes with links appear.

    ``links`` has long columns ``a`` and ``b``; direction, repeats and loops do not
    matter, nulls are left out.
    """
    spark = links.sparkSession
    pairs = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    now = written(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    said = None
    while True:
        # what a round wrote is summed up as it is written
        seen = Observation()
        new = written(_small(_large(now)).observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), "links")
        drop_written(spark, now)
        now = new
        if seen.get == said:
            break
        said = seen.get
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
