"""Sinks: content-addressed, append-only, listed and published by marker."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_content_addressed(payloads: DataFrame, content: str, path: str) -> None:
    """Payloads once each under their SHA-256, in folders by its first two digits."""
    rows = payloads.select(F.sha2(F.col(content).cast("binary"), 256).alias("sha256"), F.col(content).cast("binary").alias("content")).dropDuplicates(["sha256"])
    rows.withColumn("prefix", F.substring("sha256", 1, 2)).write.mode("errorifexists").partitionBy("prefix").option("compression", "gzip").parquet(path)


def append_results(new: DataFrame, path: str, key: str) -> None:
    """Append the results whose id is not saved yet; what is saved is never overwritten."""
    spark = new.sparkSession
    saved = spark.read.schema(new.schema).parquet(path) if _exists(spark, path) else new.limit(0)
    new.dropDuplicates([key]).join(saved.select(F.col(key).alias("_saved")), F.col(key) == F.col("_saved"), "left_anti").write.mode("append").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path, length and SHA-256 of every file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", F.sha2("content", 256).alias("sha256"))


def publish(df: DataFrame, path: str) -> None:
    """Write once; the committer's _SUCCESS file comes last."""
    df.write.mode("errorifexists").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(path)


def published(spark: SparkSession, path: str) -> bool:
    return _exists(spark, f"{path}/_SUCCESS")


def export_json_array(df: DataFrame, path: str) -> None:
    """All rows as one JSON array: a report's size, not a table's."""
    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j"))
    rows.agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("j")), ","), F.lit("]")).alias("value")).coalesce(1).write.mode("errorifexists").text(path)


def replace(df: DataFrame, path: str) -> None:
    """Write beside ``path`` and put the finished folder in its place: a reader finds the old one or the new one.

    The old folder is moved away first and deleted last; if the job fails before, it stays as it was.
    """
    spark = df.sparkSession
    new, old = f"{path}.{uuid.uuid4().hex}.new", f"{path}.{uuid.uuid4().hex}.old"
    df.write.mode("errorifexists").parquet(new)
    jvm = spark.sparkContext._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = fs.exists(at(path))
    if had and not fs.rename(at(path), at(old)):
        raise OSError(f"cannot move {path} away")
    if not fs.rename(at(new), at(path)):
        raise OSError(f"cannot put {new} in place")
    if had:
        fs.delete(at(old), True)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """``list_files`` with paths below ``root`` and a kind for each file: marker, raw, record, table or other."""
    listed = list_files(spark, root)
    name = F.element_at(F.split("path", "/"), -1)
    below = F.regexp_replace("path", r"^[a-z0-9]+:/+", "/")
    kind = (
        F.when(name.startswith("_"), "marker").when(below.contains("/raw/"), "raw").when(name.rlike(r"\.json(l|\.gz)?$"), "record").when(name.rlike(r"\.parquet$"), "table").otherwise("other")
    )
    start = F.length(F.lit(root.rstrip("/")))
    at = F.instr(below, root.rstrip("/"))
    return listed.select(F.substring(below, at + start + 1, F.length(below)).alias("path"), "length", "sha256", kind.alias("kind"))


def publish_with_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Commit a folder that is written: its manifest goes to ``_manifest``, whose own marker is the last file."""
    rows = manifest(spark, root).where("path not like '\\_manifest%'")
    rows.coalesce(1).write.mode("errorifexists").json(f"{root}/_manifest")
    return spark.read.schema(rows.schema).json(f"{root}/_manifest")


def verify_published(spark: SparkSession, root: str) -> DataFrame:
    """(path, code) of what differs from the manifest of a published folder: ``missing``, ``extra`` or ``changed``; one row
    with ``unpublished`` without the marker."""
    if not published(spark, f"{root}/_manifest"):
        return spark.createDataFrame([(root, "unpublished")], "path string, code string")
    said = spark.read.schema("path string, length long, sha256 string, kind string").json(f"{root}/_manifest").select(F.col("path").alias("_p"), F.col("length").alias("_l"), F.col("sha256").alias("_s"))
    # what Spark's readers pass over, files that begin with _ or ., is listed by the manifest's own reader only
    now = manifest(spark, root).where("path not like '\\_manifest%'")
    both = now.join(said, F.col("path") == F.col("_p"), "full_outer")
    code = F.when(F.col("path").isNull(), "missing").when(F.col("_p").isNull(), "extra").when((F.col("length") != F.col("_l")) | (F.col("sha256") != F.col("_s")), "changed")
    return both.select(F.coalesce("path", "_p").alias("path"), code.alias("code")).where("code is not null")


def export_pairs(pairs: DataFrame, path: str, left: str, right: str) -> None:
    """One JSON document for each pair of arms, in a folder of its own that the pair names."""
    named = pairs.withColumn("pair", F.concat_ws("--", left, right))
    named.repartition("pair").write.mode("errorifexists").partitionBy("pair").json(path)


def export_report(documents: dict[str, DataFrame], path: str) -> DataFrame:
    """One folder of JSON per document, and the checksum manifest of all files."""
    for name, df in documents.items():
        df.coalesce(1).write.mode("errorifexists").json(f"{path}/{name}")
    return list_files(next(iter(documents.values())).sparkSession, path)
