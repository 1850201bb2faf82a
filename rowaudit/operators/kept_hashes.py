"""Repeated audits: hashes of rows are kept by source file, and a later run hashes only files that are new or changed."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fingerprint import fingerprint

#: Folders that kept hashes are dealt to by their keys' hash.
BUCKETS = 64


def _files(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``changed``, ``length`` of the data files below a path; their contents aren't read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return listed.filter(~name.startswith("_") & ~name.startswith(".")).select(F.col("path").alias("file"), F.col("modificationTime").alias("changed"), "length")


def _manifest(spark: SparkSession, state: str, keys: list[str]) -> tuple[DataFrame | None, int]:
    """The files of the last run that ended, each with the run that hashed it, and that run's number."""
    try:
        every = spark.read.parquet(f"{state}/manifest")
    except AnalysisException:
        return None, 0
    last = every.agg(F.max("run")).first()[0]
    return every.filter(F.col("run") == last).drop("run"), last


def refreshed(spark: SparkSession, path: str, state: str, keys: list[str], *, format: str = "parquet", schema: T.StructType | None = None, **options) -> DataFrame:
    """The keys and ``row_hash`` of all rows that the files below ``path`` hold now, as ``fingerprint`` gives them.

    ``state`` is a folder of its own for each table and list of keys. It holds the hashes of files, in buckets by key, and after each
    run a manifest: which files there were, when changed, how long, and which run hashed them. A run

    1. lists the files and takes those that the last manifest hasn't, or has with another time or length;
    2. reads and hashes these alone and adds their hashes;
    3. writes its manifest. Hashes of files that are gone or changed aren't in it, so they count no more.

    A run that fails before its manifest is written leaves the last one in force. Files are told apart by path, time and
    length, so a file that is changed in place keeps neither. The manifest has a row for each file. Columns' names and types must stay the
    same; delete the state where they change. No files give no rows."""
    kept, last = _manifest(spark, state, keys)
    now = _files(spark, path)
    run, same = last + 1, ["file", "changed", "length"]
    old = now.join(kept, same) if kept is not None else now.withColumn("hashed_by", F.lit("")).limit(0)
    new = [r["file"] for r in (now.join(kept, same, "left_anti") if kept is not None else now).select("file").collect()]  # names of files
    tag = f"{run}-{uuid.uuid4().hex}"
    reader = spark.read.format(format)
    if schema is not None:
        reader = reader.schema(schema)
    if new:
        rows = reader.load(new)
        kinds = rows.schema
        hashed = fingerprint(rows, keys, columns=kinds.names, also={"_file": F.col("_metadata.file_path")}, **options)
        hashed = hashed.withColumns({"_bucket": F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in keys)), F.lit(BUCKETS)), "_run": F.lit(tag)})
        hashed.repartition("_bucket").write.mode("append").partitionBy("_run", "_bucket").parquet(f"{state}/hashes")
    plain = lambda c: F.regexp_replace(c, r"^file:/+", "file:/")  # noqa: E731 - one form of local paths
    added = now.filter(F.col("file").isin(new)) if new else now.limit(0)
    manifest = old.select(*same, "hashed_by").union(added.select(*same, F.lit(tag)))
    manifest.withColumn("run", F.lit(run)).coalesce(1).write.mode("append").parquet(f"{state}/manifest")
    current = spark.read.parquet(f"{state}/manifest").filter(F.col("run") == run)
    runs = [r[0] for r in current.select("hashed_by").distinct().collect()]  # runs whose hashes are still in force
    if not runs:
        empty = (reader.load(path) if schema is None else spark.createDataFrame([], schema)).limit(0)
        return fingerprint(empty, keys, **options)
    hashes = spark.read.parquet(f"{state}/hashes").filter(F.col("_run").isin(runs))
    live = current.select(plain("file").alias("_f"), F.col("hashed_by").alias("_r"))
    return hashes.join(live, (plain(F.col("_file")) == F.col("_f")) & (F.col("_run") == F.col("_r")), "left_semi").drop("_file", "_run", "_bucket")
