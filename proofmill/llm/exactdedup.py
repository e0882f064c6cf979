"""Exact duplicates by a content sort (DataFrame operations only).

Sampled splitters range-partition the normalised texts, an external sort by their bytes places equal texts side by
side, and a full comparison of neighbours finds the runs. Groups that would fill much of a task are found beforehand by
counting hashes; each is dealt by a salt into as many parts as it needs, and their results are joined by digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofmill.llm.common import WS, text_or_empty
from proofmill.session import partitions, stored

#: A group of over 1/PART of an average task's rows, and of HOT_ROWS at least, is dealt into parts of that size.
PART, HOT_ROWS = 4, 64
#: Leading characters that say in which range a text lies; the splitters hold no more of a text than this.
HEAD = 24


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Runs of ASCII white space count as one space. The row with the smallest id of equal
    texts stays; null ids sort last, and of repeated rows with the same id just one is kept. An empty table gives no
    rows. Other columns are ignored, whatever their names.
    """
    norm = F.regexp_replace(text_or_empty(text_col), f"{WS}+", " ")
    base = docs.select(F.col(id_col).alias("_id"), norm.alias("_norm")).withColumn("_key", F.xxhash64("_norm"))
    # so at most PART groups for each task are dealt: PART * tasks rows of 12 bytes to broadcast, however many the documents
    part = max(HOT_ROWS, docs.count() // (PART * partitions(docs.sparkSession)))
    hot = base.groupBy("_key").agg(F.count("*").alias("_n")).where(F.col("_n") > part)
    hot = stored(hot.select(F.col("_key").alias("_hot"), F.ceil(F.col("_n") / part).cast("int").alias("_parts")), "hot-keys")
    dealt = base.join(F.broadcast(hot), F.col("_key") == F.col("_hot"), "left").select(
        "_id", "_norm", "_key", F.pmod(F.xxhash64("_id"), F.col("_parts")).cast("int").alias("_salt"), F.substring("_norm", 1, HEAD).alias("_head")
    )
    order = ["_head", "_key", "_salt"]
    # the sort within a range is by the whole bytes first
    run = Window.partitionBy("_norm", *order).orderBy(F.col("_id").asc_nulls_last())
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = dealt.repartitionByRange(*order).select(
        "_id", "_salt", F.sha2(F.col("_norm").cast("binary"), 256).alias("_sha"), F.min("_id").over(whole).alias("_first"), F.count("*").over(whole).alias("_size"), F.row_number().over(run).alias("_row")
    )
    runs = stored(runs, "content-runs")
    # one row for each part of a dealt group, 2 * PART for a task at most, and one for each group after the sum
    salted = runs.where(F.col("_salt").isNotNull() & (F.col("_row") == 1)).groupBy(F.col("_sha").alias("_hot_sha")).agg(F.min("_first").alias("_hot_first"), F.sum("_size").alias("_hot_size"))
    joined = runs.join(F.broadcast(salted), F.col("_salt").isNotNull() & (F.col("_sha") == F.col("_hot_sha")), "left")
    keep = F.when(F.col("_hot_sha").isNull(), F.col("_first")).otherwise(F.col("_hot_first"))
    return joined.select(
        F.col("_id").alias("doc_id"),
        keep.alias("keep_id"),
        F.coalesce("_hot_size", "_size").cast("long").alias("group_size"),
        ((F.col("_row") == 1) & keep.eqNullSafe(F.col("_id"))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


ORACLE = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM n
"""
