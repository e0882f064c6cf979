"""Integrity rules as violation queries, and profiles that must run exactly their rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rule: str, rows: DataFrame, reference: Column, code: str) -> DataFrame:
    """rule_id, evidence_ref and code for each row."""
    return rows.select(F.lit(rule).alias("rule_id"), reference.cast("string").alias("evidence_ref"), F.lit(code).alias("code"))


def profile(rules: dict[str, DataFrame], required: list[str]) -> DataFrame:
    """One row per required rule: violations found, and valid, invalid or missing.

    A rule that was not run is missing, which counts against the target like a violation.
    """
    found = reduce(DataFrame.unionByName, rules.values())
    spark = found.sparkSession
    table = spark.createDataFrame([(r, i, r in rules) for i, r in enumerate(required)], "rule_id string, ordinal int, ran boolean")
    counts = found.groupBy(F.col("rule_id").alias("_r")).agg(F.count("*").alias("n"))
    joined = F.broadcast(table).join(counts, F.col("rule_id") == F.col("_r"), "left")
    n = F.coalesce("n", F.lit(0))
    return joined.select("rule_id", "ordinal", n.cast("long").alias("violations"), F.when(~F.col("ran"), "missing").when(n > 0, "invalid").otherwise("valid").alias("verdict"))


def declared_count(rows: DataFrame, members: str, declared: str) -> DataFrame:
    return rows.where(F.size(members) != F.col(declared))


def stored_hash(rows: DataFrame, content: Column, stored: str) -> DataFrame:
    """Rows whose stored SHA-256 is not that of their content."""
    return rows.where(~F.sha2(content.cast("binary"), 256).eqNullSafe(F.col(stored)))


def forbidden(rows: DataFrame, text: str, fragments: list[str]) -> DataFrame:
    """Rows that hold any of the fragments."""
    found = F.lit(False)
    for fragment in fragments:
        found = found | F.contains(F.col(text), F.lit(fragment))
    return rows.where(found)


def bidi_or_control(rows: DataFrame, text: str) -> DataFrame:
    """Rows with characters that reorder or hide text."""
    return rows.where(F.col(text).rlike(r"[‪-‮⁦-⁩\u0000-\u0008\u000B\u000C\u000E-\u001F]"))


def recomputed(reduction: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows in which a stored reduction and a fresh one differ, as a multiset."""
    signed = reduction.withColumn("_n", F.lit(1)).unionByName(fresh.withColumn("_n", F.lit(-1)))
    return signed.groupBy(*reduction.columns).agg(F.sum("_n").alias("surplus")).where("surplus <> 0")
