"""Selection, top rows, facets and set comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stratified_hash_top(rows: DataFrame, stratum: str, key: str, prefix: str, k: int, separator: str = "\0") -> DataFrame:
    """The first ``k`` of each stratum by SHA-256 of prefix, separator and id, then by id: stable under any order of input.

    A stratum with fewer rows is an error. Spark limits each partition to k rows per stratum before the shuffle, and the
    check counts the k rows that are left.
    """
    digest = F.sha2(F.concat(F.lit(prefix + separator), F.col(key).cast("string")).cast("binary"), 256)
    ranked = rows.withColumn("selection_rank", digest).withColumn("place", F.row_number().over(Window.partitionBy(stratum).orderBy("selection_rank", key)))
    first = ranked.where(F.col("place") <= k)
    few = F.count("*").over(Window.partitionBy(stratum)) < k
    return first.withColumn("place", F.when(few, F.raise_error(F.lit("a stratum has too few rows")).cast("int")).otherwise(F.col("place")))


def manifest_selection(manifest: DataFrame, runtime: DataFrame, requested: DataFrame, key: str, ordinal: str) -> tuple[DataFrame, DataFrame]:
    """The requested cases in the manifest's order, and what does not close.

    ``manifest`` and ``runtime`` have key and ordinal, ``requested`` key and ``place``. Violations (code, ref):
    ``duplicate_manifest``, ``duplicate_request``, ``unknown_request``, ``out_of_order`` for a request that stands before
    one of a smaller ordinal, ``runtime_differs`` for cases that manifest and runtime do not share at one ordinal.
    """
    m = manifest.select(F.col(key).alias("_k"), F.col(ordinal).alias("_o"))
    joined = requested.select(F.col(key).alias("_r"), "place").join(m, F.col("_r") == F.col("_k"), "left")
    before = F.max("_o").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1))  # one row per request
    code = lambda name, rows, ref: rows.select(F.lit(name).alias("code"), F.col(ref).cast("string").alias("ref"))
    both = m.join(runtime.select(F.col(key).alias("_rk"), F.col(ordinal).alias("_ro")), (F.col("_k") == F.col("_rk")) & (F.col("_o") == F.col("_ro")), "full_outer")
    found = [
        code("duplicate_manifest", m.groupBy("_k").count().where("count > 1"), "_k"),
        code("duplicate_request", requested.groupBy(F.col(key).alias("_r")).count().where("count > 1"), "_r"),
        code("unknown_request", joined.where("_k is null"), "_r"),
        code("out_of_order", joined.withColumn("_before", before).where("_o < _before"), "_r"),
        code("runtime_differs", both.where("_k is null or _rk is null").select(F.coalesce("_k", "_rk").alias("_k")).distinct(), "_k"),
    ]
    issues = found[0]
    for more in found[1:]:
        issues = issues.unionByName(more)
    return joined.where("_k is not null").select(F.col("_r").alias(key), F.col("_o").alias(ordinal)), issues


def top_candidates(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)


def in_manifest_order(rows: DataFrame, manifest: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Rows of the manifest's keys, with its ordinal."""
    m = manifest.select(F.col(key).alias("_k"), F.col(ordinal))
    return rows.join(m, F.col(key) == F.col("_k")).drop("_k")


def remaining(manifest: DataFrame, saved: DataFrame, key: str) -> DataFrame:
    return manifest.join(saved.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")


def unknown_keys(selection: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return selection.select(key).distinct().join(known.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")


def set_closure(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Sizes of both differences and of the intersection of two key sets, in one join."""
    a, b = left.select(F.col(key).alias("_a")).distinct(), right.select(F.col(key).alias("_b")).distinct()
    both = a.join(b, F.col("_a").eqNullSafe(F.col("_b")), "full_outer")
    return both.agg(
        F.count_if(F.col("_b").isNull()).alias("only_left"), F.count_if(F.col("_a").isNull()).alias("only_right"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("in_both")
    ).withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows with the surplus of copies that the left (positive) or right (negative) has."""
    columns = left.columns
    signed = left.withColumn("_n", F.lit(1)).unionByName(right.withColumn("_n", F.lit(-1)))
    return signed.groupBy(*columns).agg(F.sum("_n").alias("surplus")).where("surplus <> 0")


def facet_filter(rows: DataFrame, facets: dict[str, list], text: Column | None = None, needle: str = "") -> DataFrame:
    """Any of a facet's values, all facets, and a piece of text in any case."""
    out = rows
    for column, values in facets.items():
        out = out.where(F.col(column).isin(*values)) if values else out
    return out.where(F.contains(F.lower(text), F.lit(needle.lower()))) if text is not None and needle else out


def facet_values(rows: DataFrame, facets: list[str]) -> DataFrame:
    """The sorted distinct values of each facet with their counts."""
    long = rows.select(*[F.col(f).cast("string").alias(f) for f in facets]).unpivot([], facets, "facet", "value")
    return long.where("value is not null").groupBy("facet", "value").count()


def any_member(results: DataFrame, by: list[str], predicate: Column) -> DataFrame:
    """Groups of which at least one member satisfies the predicate; null is not satisfied."""
    return results.groupBy(*by).agg(F.count_if(predicate).alias("hits"), F.count("*").alias("members")).where("hits > 0")


def display_state(state: Column, judged: Column, correct: Column) -> Column:
    """What a case shows: the order of the branches decides."""
    return F.when(state == "failed", "failed").when(state == "pending", "pending").when(~judged, "unjudged").when(correct, "correct").otherwise("incorrect")


def mode_pick(rows: DataFrame, value: str) -> DataFrame:
    """The most frequent value; ties go to the smallest."""
    return rows.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(value)).limit(1)
