"""Folders as tables: listings, stable ids, fingerprints, change pages, snapshots."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import file_extension, path_ids
from docloom.sources.scratch import scratch_path

#: Files of one folder that rows are landed in, and folders whose files are listed at once.
FOLDER_FILES, FOLDERS = 1000, 100
EXTENSIONS = ["pptx", "docx", "pdf", "xlsx", "xlsb"]
FEED_SCHEMA = """value array<struct<id:string,name:string,webUrl:string,cTag:string,eTag:string,size:bigint,lastModifiedDateTime:string,
  parentReference:struct<siteId:string,driveId:string,path:string>,
  createdBy:struct<user:struct<email:string,displayName:string>>,lastModifiedBy:struct<user:struct<email:string,displayName:string>>,
  file:struct<mimeType:string>,folder:struct<childCount:int>,deleted:struct<state:string>>>,
  `@odata.nextLink` string, `@odata.deltaLink` string"""


def _landing(path: str, most: int):
    """Task that writes each value to a file of its own and tells of its folders.  They have
    the attempt's number, so only those of attempts that have ended well are told of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, made = TaskContext.get(), 0, []
        for batch in batches:
            for text in batch.column(0):
                if n % most == 0:
                    made.append(f"{path}/{task.partitionId():05d}-{task.taskAttemptId()}-{n // most:05d}")
                    os.makedirs(made[-1], exist_ok=True)
                with open(f"{made[-1]}/{n % most:05d}.txt", "wb") as file:
                    file.write(text.as_buffer())
                n += 1
        yield pa.RecordBatch.from_pydict({"folder": pa.array(made, pa.string())})

    return run


def land(rows: DataFrame, path: str, most: int = FOLDER_FILES) -> list[str]:
    """Write each row's ``text`` and a line end as a file of its own, at most ``most`` in a
    folder; the folders.

    On a local or mounted file system tasks write them by themselves: Hadoop's starts two
    processes a file for its rights.  Any other is written by Spark, into one folder."""
    spark = rows.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() != "file":
        # tasks move their files into place themselves: the other way the driver moves them one by one
        rows.select("text").write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).text(path)
        return [path]
    fs.mkdirs(p)
    lines = rows.select(F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).cast("binary").alias("line"))
    return [f"file:{r.folder}" for r in lines.mapInArrow(_landing(p.toUri().getPath(), most), "folder string").collect()] or [path]


def listed(spark: SparkSession, folders: list[str], extensions: list[str] = EXTENSIONS, most: int = FOLDERS) -> DataFrame:
    """``listing`` of many folders with fingerprints, written: the driver, which plans a scan
    by the names of its files, holds those of ``most`` folders at once."""
    path = scratch_path(spark, "listed")
    for k in range(0, len(folders), most):
        # a partition of a scan holds few small files, so many of them are one task
        found = listing(spark, folders[k : k + most], extensions, fingerprint=True).coalesce(4 * spark.sparkContext.defaultParallelism)
        found.write.mode("append").parquet(path)
    return spark.read.schema(found.schema).parquet(path)


def listing(spark: SparkSession, folder: str | list[str], extensions: list[str] = EXTENSIONS, glob: str = "*", fingerprint: bool = False) -> DataFrame:
    """(path, name, length, modified_at, drive_id, item_id) of all supported files below a
    folder, or several.  Contents are not read; the ids come from the path, so a new run finds the same.

    With ``fingerprint`` they are read, once, for ``content_hash`` as of ``fingerprints``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    name = F.substring_index("path", "/", -1)
    out = files.select("path", name.alias("name"), "length", F.col("modificationTime").alias("modified_at"), *path_ids(F.col("path")), *([F.sha2("content", 256).alias("content_hash")] if fingerprint else []))
    return out.where(file_extension(F.col("name")).isin(extensions))


def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content_hash): sha-256 of the bytes of every file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.sha2("content", 256).alias("content_hash"))


def items(pages: DataFrame) -> DataFrame:
    """Flat feed items of JSON change pages; a present facet is a true flag."""
    i = pages.select(F.posexplode("value").alias("position", "i"))
    email = F.coalesce("i.lastModifiedBy.user.email", "i.lastModifiedBy.user.displayName")
    return i.select(
        F.col("position").cast("long"),
        F.col("i.id").alias("item_id"),
        F.col("i.parentReference.driveId").alias("drive_id"),
        F.col("i.name").alias("name"),
        F.col("i.cTag").alias("ctag"),
        F.col("i.eTag").alias("etag"),
        F.col("i.parentReference.path").alias("parent_path"),
        F.col("i.size").alias("size"),
        F.col("i.webUrl").alias("url"),
        F.col("i.parentReference.siteId").alias("site_id"),
        F.col("i.file.mimeType").alias("mime_type"),
        F.coalesce("i.createdBy.user.email", "i.createdBy.user.displayName").alias("created_by"),
        email.alias("modified_by"),
        F.try_to_timestamp("i.lastModifiedDateTime").alias("modified_at"),
        F.col("i.deleted").isNotNull().alias("is_deleted"),
        (F.col("i.folder").isNotNull() | (F.col("i.file").isNull() & F.col("i.deleted").isNull())).alias("is_folder"),
    )


def drive_items(rows: DataFrame, extensions: list[str] = EXTENSIONS) -> DataFrame:
    """(drive_id, item_id) of all supported files in a drive: feed items, from the pages of
    all its folders, without folders, deleted items and repeats."""
    files = rows.where(~F.col("is_folder") & ~F.col("is_deleted") & file_extension(F.col("name")).isin(extensions))
    return files.select("drive_id", "item_id").distinct()


def feed(spark: SparkSession, folder: str | list[str]) -> DataFrame:
    return items(spark.read.schema(FEED_SCHEMA).option("multiLine", True).json(folder))


def feed_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The landing folder of change pages as a stream; Spark's checkpoint is the cursor."""
    return items(spark.readStream.schema(FEED_SCHEMA).option("multiLine", True).json(folder))


def write_chunks(chunks: DataFrame, documents: DataFrame, path: str) -> None:
    """Append chunks with their document's title and department, by knowledge base."""
    chunks.join(documents.select("document_id", "title", "department", "kb"), "document_id").write.partitionBy("kb").mode("append").parquet(path)


def write_snapshot(rows: DataFrame, base: str, version: int) -> str:
    """Write a new version beside the old ones.  A finished one is left as it is (a replayed
    batch would write the same); what a lost run left of one is overwritten."""
    path = f"{base.rstrip('/')}/v={version}"
    if not finished(rows.sparkSession, path):
        rows.write.mode("overwrite").parquet(path)
    return path


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def clear(spark: SparkSession, base: str, version: int) -> str:
    """An empty version of the same schema."""
    last = spark.read.parquet(f"{base.rstrip('/')}/v={version - 1}")
    return write_snapshot(last.limit(0), base, version)
