"""Joins of evidence records. Build sides that must be unique are checked, never silently deduplicated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofmill.session import stored


def duplicate_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that more than one row has: the guard of every join that takes one row per key."""
    return rows.groupBy(*key).agg(F.count("*").alias("copies")).where("copies > 1")


def strict_lookup(rows: DataFrame, table: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Left join; a key that the table lacks is an error when the row is read."""
    t = table.select(F.col(key).alias("_k"), *values)
    joined = rows.join(t, F.col(key) == F.col("_k"), "left")
    checked = F.when(F.col("_k").isNull() & F.col(key).isNotNull(), F.raise_error(F.concat(F.lit(f"unknown {key}: "), F.col(key).cast("string"))).cast("string"))
    return joined.where(checked.isNull()).drop("_k")


def explode_lookup(rows: DataFrame, ids: str, table: DataFrame, key: str) -> DataFrame:
    """One row for each id of an array that the table knows; other ids are skipped."""
    return rows.withColumn("_id", F.explode(ids)).join(table, F.col("_id") == F.col(key)).drop("_id")


def producer_usage(attempts: DataFrame, usage: DataFrame, attempt: str, kind: str, tokens: str) -> DataFrame:
    """Tokens of an attempt's one model record; without any, of its one operation record; else null with a reason."""
    sums = usage.groupBy(attempt).agg(
        F.count_if(F.col(kind) == "model").alias("n_model"), F.max(F.when(F.col(kind) == "model", F.col(tokens))).alias("model_tokens"),
        F.count_if(F.col(kind) == "operation").alias("n_operation"), F.max(F.when(F.col(kind) == "operation", F.col(tokens))).alias("operation_tokens"),
    ).withColumnRenamed(attempt, "_a")
    n_model, n_operation = F.coalesce("n_model", F.lit(0)), F.coalesce("n_operation", F.lit(0))
    picked = F.when(n_model == 1, F.col("model_tokens")).when((n_model == 0) & (n_operation == 1), F.col("operation_tokens"))
    source = F.when(n_model == 1, "model").when((n_model == 0) & (n_operation == 1), "operation").when(n_model + n_operation == 0, "missing").otherwise("ambiguous")
    return attempts.join(sums, F.col(attempt) == F.col("_a"), "left").select(*attempts.columns, picked.alias("tokens"), source.alias("source"))


def first_hit(keys: DataFrame, key: str, sources: list[DataFrame], value: str) -> DataFrame:
    """The value of the first source that knows a key."""
    ranked = [s.select(F.col(key).alias("_k"), F.struct(F.lit(i).alias("rank"), F.col(value).alias("v")).alias("_h")) for i, s in enumerate(sources)]
    hits = ranked[0]
    for more in ranked[1:]:
        hits = hits.unionByName(more)
    best = hits.groupBy("_k").agg(F.min("_h").alias("_h"))
    return keys.join(best, F.col(key) == F.col("_k"), "left").select(*keys.columns, F.col("_h.v").alias("value"), F.col("_h.rank").alias("source_rank"))


def nest(rows: DataFrame, by: list[str], order: list[str], fields: list[str], name: str) -> DataFrame:
    """The rows of a group as an ordered array of structs; for groups of bounded size such as the arms of a question."""
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias(name))


def retry_chains(attempts: DataFrame, attempt: str, predecessor: str, longest: int = 3) -> DataFrame:
    """root, depth and whether the chain closes within ``longest`` attempts, by that many self joins less one."""
    link = attempts.select(F.col(attempt).alias("_a"), F.col(predecessor).alias("_p"))
    state = attempts.select(F.col(attempt), F.col(attempt).alias("root"), F.col(predecessor).alias("_next"), F.lit(1).alias("depth"))
    for _ in range(longest - 1):
        known = link.select(F.col("_a").alias("_ka"), F.col("_p").alias("_kp"))
        joined = state.join(known, F.col("_next") == F.col("_ka"), "left")
        moved = F.col("_ka").isNotNull()
        state = joined.select(attempt, F.when(moved, F.col("_ka")).otherwise(F.col("root")).alias("root"), F.when(moved, F.col("_kp")).otherwise(F.col("_next")).alias("_next"), F.when(moved, F.col("depth") + 1).otherwise(F.col("depth")).alias("depth"))
    return state.select(attempt, "root", "depth", F.col("_next").isNull().alias("closed"))


def recursive_chains(attempts: DataFrame, attempt: str, predecessor: str) -> DataFrame:
    """attempt, root and depth for chains of any length, by pointer doubling: a chain of n attempts takes log2(n) joins.

    An attempt whose predecessor is unknown is a root that says so: ``root`` is that predecessor. A chain that closes
    in a ring has no root and is left out.
    """
    kind = dict(attempts.dtypes)[attempt]
    known = attempts.select(F.col(attempt).alias("_id"), F.col(predecessor).alias("_up"))
    state = stored(known.select("_id", "_up", F.col("_id").alias("_top"), F.lit(1).alias("_depth")), "chains")
    rows, rounds = state.count(), 0
    while state.where("_up is not null").limit(1).count() and (1 << rounds) <= 2 * rows:
        above = state.select(F.col("_id").alias("_a"), F.col("_up").alias("_next"), F.col("_top").alias("_over"), F.col("_depth").alias("_more"))
        joined = state.join(above, F.col("_up") == F.col("_a"), "left")
        lost = F.col("_up").isNotNull() & F.col("_a").isNull()
        top = F.when(F.col("_up").isNull(), F.col("_top")).when(lost, F.col("_up")).otherwise(F.col("_over"))
        state = stored(joined.select("_id", F.col("_next").alias("_up"), top.alias("_top"), (F.col("_depth") + F.coalesce("_more", F.lit(0))).alias("_depth")), "chains")
        rounds += 1
    return state.where("_up is null").select(F.col("_id").cast(kind).alias(attempt), F.col("_top").alias("root"), F.col("_depth").alias("depth"))


def in_intervals(points: DataFrame, spans: DataFrame, by: list[str], point: str, start: str, end: str, label: str, default: str) -> DataFrame:
    """The label of the disjoint span that holds each point; ``default`` outside all spans.

    A merge rather than a range join: spans and points are put in one order per group, and a point takes the last span
    that began before it. Linear in both sides, without pairs to discard.
    """
    s = spans.select(*by, F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.struct(F.col(end).alias("e"), F.col(label).alias("l")).alias("_span"))
    p = points.select(*by, F.col(point).alias("_at"), F.lit(1).alias("_kind"), F.struct(*[c for c in points.columns if c not in by]).alias("_row"))
    both = s.unionByName(p, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("_last", F.last("_span", ignorenulls=True).over(w)).where("_kind = 1")
    return held.select(*by, "_row.*", F.when(F.col("_at") < F.col("_last.e"), F.col("_last.l")).otherwise(default).alias(label))


def as_of(left: DataFrame, right: DataFrame, by: list[str], time: str, value: str) -> DataFrame:
    """The last value of the right at or before each row of the left; one pass over the union of both."""
    r = right.select(*by, F.col(time).alias("_at"), F.lit(0).alias("_kind"), F.col(value).alias("_value"))
    rows = left.select(*by, F.col(time).alias("_at"), F.lit(1).alias("_kind"), F.struct(*[c for c in left.columns if c not in by]).alias("_row"))
    w = Window.partitionBy(*by).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(rows, allowMissingColumns=True).withColumn("_last", F.last("_value", ignorenulls=True).over(w)).where("_kind = 1")
    return both.select(*by, "_row.*", F.col("_last").alias(value))


def interleave(facts: DataFrame, chunks: DataFrame, by: list[str], rank: str, reference: str) -> DataFrame:
    """Facts in their order, each chunk after the first fact that names it, chunks that none names last, in their own order."""
    first = facts.where(F.col(reference).isNotNull()).groupBy(*by, reference).agg(F.min(rank).alias("_first"))
    f = facts.select(*by, F.lit("fact").alias("kind"), F.col(rank).alias("_a"), F.lit(0).alias("_b"), F.col(rank).alias("source_rank"))
    c = chunks.join(first, [*by, reference], "left").select(*by, F.lit("chunk").alias("kind"), F.coalesce("_first", F.lit(2**62)).alias("_a"), F.lit(1).alias("_b"), F.col(f"{rank}").alias("source_rank"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("_a", "_b", "source_rank"))
    return f.unionByName(c).withColumn("place", place).drop("_a", "_b")


def field_mismatches(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keys whose fields differ, nulls being equal to nulls; ``missing`` marks keys that the right lacks, ``extra`` those
    that only the right has."""
    a = left.select(key, *fields, F.lit(True).alias("_left"))
    b = right.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_r_{f}") for f in fields], F.lit(True).alias("_right"))
    joined = a.join(b, F.col(key) == F.col("_k"), "full_outer")
    differing = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_r_{f}")), F.lit(f)) for f in fields]))
    found = F.when(F.col("_right").isNull(), F.array(F.lit("missing"))).when(F.col("_left").isNull(), F.array(F.lit("extra"))).otherwise(differing)
    return joined.select(F.coalesce(key, "_k").alias(key), found.alias("differing")).where(F.size("differing") > 0)


def quote_provenance(quotes: DataFrame, messages: DataFrame, by: list[str], quote: str, text: str) -> DataFrame:
    """How many messages of its key hold each quote; exactly one is provenance."""
    m = messages.select(*[F.col(c).alias(f"_{c}") for c in by], F.col(text).alias("_text"))
    on = [F.col(c) == F.col(f"_{c}") for c in by] + [F.contains(F.col("_text"), F.col(quote))]
    joined = quotes.join(m, on, "left")
    return joined.groupBy(*quotes.columns).agg(F.count("_text").alias("sources")).withColumn("proven", F.col("sources") == 1)


def orphan_keys(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    p = parent.select(F.col(parent_key).alias("_p"))
    return child.where(F.col(key).isNotNull()).join(p, F.col(key) == F.col("_p"), "left_anti")


def contribution_view(records: DataFrame, final_plans: DataFrame, parent: str) -> DataFrame:
    """``final_contribution`` where the record's parent is a final plan, else ``attempted``."""
    final = final_plans.select(F.col(parent).alias("_f")).distinct()
    return records.join(final, F.col(parent) == F.col("_f"), "left").withColumn("view", F.when(F.col("_f").isNotNull(), "final_contribution").otherwise("attempted")).drop("_f")


def inline_or_body(hits: DataFrame, bodies: DataFrame, key: str, level: str, abstract: str, body: str) -> DataFrame:
    """Hits below level 2 carry their abstract, others take the body of their key."""
    b = bodies.select(F.col(key).alias("_k"), F.col(body).alias("_body"))
    return hits.join(b, F.col(key) == F.col("_k"), "left").withColumn("content", F.when(F.col(level) < 2, F.col(abstract)).otherwise(F.col("_body"))).drop("_k", "_body")
