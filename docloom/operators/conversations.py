"""Turns of conversations: recent context, latest question."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_turns(turns: DataFrame, n: int = 10) -> DataFrame:
    """The n turns before the last one of each conversation."""
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("_r", F.row_number().over(back)).where((F.col("_r") > 1) & (F.col("_r") <= n + 1)).drop("_r")


def history_text(turns: DataFrame, n: int = 10, each: int = 200) -> DataFrame:
    """``role: text`` lines of the last turns, each text cut."""
    line = F.struct("turn", F.concat("role", F.lit(": "), F.substring("text", 1, each)).alias("t"))
    return last_turns(turns, n).groupBy("conv_id").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"])).alias("history"))


def latest_question(turns: DataFrame) -> DataFrame:
    return turns.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("question"))
