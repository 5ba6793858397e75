"""Tables in hash buckets: a version holds only the buckets that its batch has touched.

``base/data/v=N/bucket=K`` are the rows of bucket K as of version N, and ``base/state/N.json``
says, for every bucket, which version holds it.  The state is written last and renamed into
place, so a version without it does not exist, and a replayed batch overwrites what a lost
run left.  Bytes written follow the batch, not the table.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Buckets of a table where its maker does not say; they are rewritten whole, so a large
#: table has many.
BUCKETS = 64


def bucket_of(key: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*[F.col(c) for c in key]), F.lit(buckets)).cast("int")


def touched(rows: DataFrame, key: list[str], buckets: int = BUCKETS) -> list[int]:
    """Numbers of the buckets that hold these keys: at most ``buckets``."""
    return sorted(r.b for r in rows.select(bucket_of(key, buckets).alias("b")).distinct().collect())


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def versions(spark: SparkSession, base: str) -> list[int]:
    """Finished versions, oldest first."""
    return sorted(int(n[:-5]) for n in _names(spark, f"{base}/state") if n.endswith(".json"))


def _state(spark: SparkSession, base: str, upto: int | None) -> tuple[StructType | None, dict[int, int | None]]:
    """Schema, and the version that holds each bucket; None where it is empty."""
    known = [v for v in versions(spark, base) if upto is None or v <= upto]
    if not known:
        return None, {}
    fs, p = _fs(spark, f"{base}/state/{known[-1]}.json")
    source = fs.open(p)
    try:
        said = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
    finally:
        source.close()
    return StructType.fromJson(said["schema"]), {int(b): v for b, v in said["buckets"].items()}


def create(rows: DataFrame, base: str, key: list[str], buckets: int = BUCKETS) -> None:
    """Version 0 with all buckets."""
    save(rows, base, 0, list(range(buckets)), key, buckets)


def save(rows: DataFrame, base: str, version: int, which: list[int], key: list[str], buckets: int = BUCKETS) -> None:
    """``rows`` become all that the buckets ``which`` hold from this version on; the other
    buckets stay.  A finished version is left as it is."""
    base, spark = base.rstrip("/"), rows.sparkSession
    if version in versions(spark, base):
        return
    schema, state = _state(spark, base, version - 1)
    held: set[int] = set()
    if which:
        path = f"{base}/data/v={version}"
        # a large bucket is several tasks, which sort its rows without a spill
        rows.withColumn("bucket", bucket_of(key, buckets)).hint("rebalance", "bucket").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(path)
        held = {int(n.split("=")[1]) for n in _names(spark, path) if n.startswith("bucket=")}
    state |= {b: version if b in held else None for b in which}
    fs, temporary = _fs(spark, f"{base}/state/{version}.unfinished")
    out = fs.create(temporary, True)
    out.write(bytearray(json.dumps({"schema": (schema or rows.schema).jsonValue(), "buckets": state}).encode()))
    out.close()
    fs.rename(temporary, _fs(spark, f"{base}/state/{version}.json")[1])


def load(spark: SparkSession, base: str, which: list[int] | None = None, upto: int | None = None) -> DataFrame:
    """Rows of the table, or of some buckets, as of version ``upto``; no other bucket is read."""
    base = base.rstrip("/")
    schema, state = _state(spark, base, upto)
    if schema is None:
        raise FileNotFoundError(f"no finished version of a bucketed table in {base}")
    wanted = state.keys() if which is None else set(which)
    paths = [f"{base}/data/v={v}/bucket={b}" for b, v in sorted(state.items()) if v is not None and b in wanted]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)


def expire(spark: SparkSession, base: str, keep: int = 2) -> int:
    """Delete buckets that none of the last ``keep`` versions reads; how many went.

    A stream replays its last batch at most, which reads the version before."""
    base = base.rstrip("/")
    known = versions(spark, base)
    read = {(v, b) for n in known[-keep:] for b, v in _state(spark, base, n)[1].items() if v is not None}
    gone = 0
    for name in _names(spark, f"{base}/data"):
        v = int(name[2:])
        if len(known) <= keep or v >= known[-keep]:
            continue
        left = [n for n in _names(spark, f"{base}/data/{name}") if n.startswith("bucket=")]
        old = [n for n in left if (v, int(n.split("=")[1])) not in read]
        # a folder without buckets that are read goes as a whole
        for path in [f"{base}/data/{name}"] if len(old) == len(left) else [f"{base}/data/{name}/{n}" for n in old]:
            fs, p = _fs(spark, path)
            fs.delete(p, True)
        gone += len(old)
    for v in known[:-keep]:
        fs, p = _fs(spark, f"{base}/state/{v}.json")
        fs.delete(p, True)
    return gone
