"""Mixing sources to target weights by systematic sampling.

Within a source the documents stand in a fixed order, by size class and then by id. The prefix sum of their expected
copies plus one random offset per source crosses integer boundaries; a document is emitted once for each crossing in
its stretch. Ranks come from a bounded histogram of cells, so a source with a third of all rows is no single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofmill.llm.common import text_or_empty, word_count
from proofmill.session import stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
SEED = "mix-1"
#: Cells of a source: CLASSES size classes of CLASS_WORDS words each, the last without an end, by PARTS parts of the ids,
#: by a range of the ids for each RANGE_ROWS documents, RANGES at most. However ids are dealt, a source has at most
#: CLASSES * PARTS * (RANGES + 1) cells. Order within a source does not depend on the number of ranges.
CLASS_WORDS, CLASSES, PARTS, RANGES, RANGE_ROWS = 64, 512, 64, 32, 1 << 18


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Id, source, size and cell of each row, and a key of its content, as a table: texts are read once."""
    size = word_count(text_or_empty(text_col))
    key = F.xxhash64(F.col(id_col).cast("long"), F.col(source_col).cast("string"), F.col(text_col).cast("string"))
    rows = stored(docs.select(F.col(id_col).cast("long").alias("_id"), F.col(source_col).cast("string").alias("_source"), size.alias("_size"), key.alias("_key")), "mix-sizes")
    low, high, count = rows.agg(F.min("_id"), F.max("_id"), F.count("*")).head()
    width = ((high or 0) - (low or 0)) // min(RANGES, 1 + count // RANGE_ROWS) + 1
    return rows.select(
        "*",
        F.least(F.floor(F.col("_size") / CLASS_WORDS), F.lit(CLASSES - 1)).cast("int").alias("_class"),
        F.coalesce(F.pmod("_id", F.lit(PARTS)), F.lit(0)).cast("int").alias("_part"),
        F.coalesce(F.call_function("div", F.col("_id") - F.lit(low or 0), F.lit(width)), F.lit(RANGES)).cast("int").alias("_range"),
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """_source, _source_size, _target from rows (_source, _cell_size): one row per source.

    Sources by code point, null last, weigh ``weights`` in turn. The total is ``share`` of all sizes. What is above
    ``cap`` times a source's size goes to the others by weight until none is above: sources are filled in ascending
    order of cap per weight, so those that stop at the cap are a prefix, and the rest share what is left by weight.
    The table has one row per source, so its windows are small.
    """
    totals = sizes.groupBy("_source").agg(F.sum("_cell_size").alias("_source_size"))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("_source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = totals.withColumn("_w", F.element_at(cycle, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    every = Window.partitionBy(F.lit(0))
    fill = every.orderBy((F.col("_source_size") / F.col("_w")).asc(), F.col("_source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = ranked.select(
        "*",
        (F.sum("_source_size").over(every) * F.lit(share) - F.coalesce(F.sum("_source_size").over(before), F.lit(0)) * F.lit(cap)).alias("_left"),
        F.sum("_w").over(onward).alias("_weight_left"),
    )
    # the level at which a source and all after it would share what is left; sources above it stop at their cap
    ranked = ranked.withColumn("_capped", F.col("_left") / F.col("_weight_left") * F.col("_w") >= F.col("_source_size") * F.lit(cap))
    level = F.min(F.when(~F.col("_capped"), F.struct("_weight_left_desc", "_level"))).over(every)
    ranked = ranked.withColumn("_weight_left_desc", -F.col("_weight_left")).withColumn("_level", F.col("_left") / F.col("_weight_left"))
    return ranked.withColumn("_share", level["_level"]).select(
        "_source", "_source_size", F.when(F.col("_capped"), F.col("_source_size") * F.lit(cap)).otherwise(F.col("_share") * F.col("_w")).cast("double").alias("_target")
    )


def _copies(sized: DataFrame, seed: str) -> DataFrame:
    cells = sized.groupBy("_source", "_class", "_part", "_range").agg(F.count("*").alias("_rows"), F.sum("_size").alias("_cell_size"))
    cells = stored(cells, "mix-cells")
    targets = source_targets(cells)
    # a bounded number of rows for one source, whatever the number of documents
    before = Window.partitionBy("_source").orderBy("_class", "_part", "_range").rowsBetween(Window.unboundedPreceding, -1)
    based = cells.withColumn("_base", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    t = targets.select(F.col("_source").alias("_s"), "_source_size", "_target")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce("_source", F.lit("\x00"))).cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(float(2**32))
    based = based.join(t, F.col("_source").eqNullSafe(F.col("_s"))).select(
        F.col("_source").alias("_cs"), F.col("_class").alias("_cc"), F.col("_part").alias("_cp"), F.col("_range").alias("_cr"), "_base", "_source_size", "_target", offset.alias("_offset"),
        F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0)).alias("_rate"),
    )
    place = F.row_number().over(Window.partitionBy("_source", "_class", "_part", "_range").orderBy(F.col("_id").asc_nulls_last(), "_size", "_key"))
    ranked = sized.withColumn("_place", place)
    same = F.col("_source").eqNullSafe(F.col("_cs")) & (F.col("_class") == F.col("_cc")) & (F.col("_part") == F.col("_cp")) & (F.col("_range") == F.col("_cr"))
    ranked = ranked.join(based, same)
    end = F.col("_base") + F.col("_place")
    crossed = F.floor(end * F.col("_rate") + F.col("_offset")) - F.floor((end - 1) * F.col("_rate") + F.col("_offset"))
    return ranked.withColumn("_copies", crossed.cast("long"))


def mix_sources(docs: DataFrame, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, source.

    Size is the number of words; null text has none. A null source is a source of its own, last in order. A null id
    sorts last in its cell; rows that repeat an id are sampled one by one. Where all sizes are 0 nothing is taken. An
    empty table gives no rows. Other columns are ignored.
    """
    ranked = _copies(_sizes(docs, id_col, text_col, source_col), seed)
    return ranked.select(
        F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").cast("long").alias("source_size"),
        F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"), F.col("_copies").alias("copies"), F.col("_source").alias("source"),
    )


def emit_mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mixed rows themselves, each document as often as the mix takes it, with the columns of ``docs``.

    Rows of one id, source and text share their copies evenly; null ids are told apart by source and text. Rows that the
    mix does not take, and all where there are no words, give none. An empty table gives no rows.
    """
    taken = _copies(_sizes(docs, "doc_id", "text", "source"), seed).groupBy(F.col("_key").alias("_taken")).agg(F.sum("_copies").alias("_copies"), F.count("*").alias("_rows"))
    rows = docs.select(F.xxhash64(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")).alias("_key"), F.struct("*").alias("_doc"))
    # one key for the join and the window: whole rows are shuffled once
    joined = rows.join(taken.where("_copies > 0"), F.col("_key") == F.col("_taken"))
    nth = F.row_number().over(Window.partitionBy("_key").orderBy("_rows"))
    times = F.floor(F.col("_copies") / F.col("_rows")) + F.when(nth <= F.col("_copies") % F.col("_rows"), 1).otherwise(0)
    return joined.select("_doc", times.cast("int").alias("_times")).where(F.col("_times") > 0).select("_doc", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_doc.*")


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::DOUBLE AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source
), w AS (
  SELECT *, CASE (k - 1) % 3 WHEN 0 THEN {WEIGHTS[0]}.0 WHEN 1 THEN {WEIGHTS[1]}.0 ELSE {WEIGHTS[2]}.0 END::DOUBLE AS w FROM s
), f AS (
  SELECT *, (sum(source_size) OVER ()) * {SHARE} - {CAP} * coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight
  FROM w
), l AS (
  SELECT *, rest / weight * w >= {CAP} * source_size AS capped FROM f
), t AS (
  SELECT source, source_size, CASE WHEN capped THEN {CAP} * source_size ELSE w * (SELECT arg_max(rest / weight, weight) FROM l WHERE NOT capped) END AS target,
         ('0x' || substr(md5('{SEED}:' || coalesce(source, chr(0))), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS shift
  FROM l
), r AS (
  SELECT d.*, t.source_size, t.target, t.shift, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY least(size // {CLASS_WORDS}, {CLASSES - 1}), coalesce(doc_id % {PARTS}, 0), doc_id NULLS LAST, size) AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       ((floor(place * rate + shift) - floor((place - 1) * rate + shift)) * size)::BIGINT AS taken,
       (floor(place * rate + shift) - floor((place - 1) * rate + shift))::BIGINT AS copies, source
FROM r
"""
