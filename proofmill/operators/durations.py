"""Durations in integer microseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def microseconds(start: Column, end: Column) -> Column:
    return F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))


def interval(started: Column, ended: Column) -> Column:
    """Microseconds between two texts with offsets; null if one is missing, without offset, invalid or later than the other."""
    offset = r"(Z|[+-]\d{2}:?\d{2})$"
    a, b = F.try_to_timestamp(started), F.try_to_timestamp(ended)
    return F.when(started.rlike(offset) & ended.rlike(offset) & (b >= a), microseconds(a, b))


def duration_summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, exact median, nearest-rank 95th percentile and maximum of the non-null values.

    Both percentiles come from one sort-free count of equal values per group.
    """
    return rows.groupBy(*by).agg(
        F.count(value).alias("count"), F.expr(f"percentile({value}, 0.5)").alias("median_us"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").cast("long").alias("p95_us"), F.max(value).alias("max_us")
    )


def wall_time(attempts: DataFrame, case: list[str], start: str, end: str) -> DataFrame:
    """Per case, the last end minus the first start."""
    return attempts.groupBy(*case).agg(microseconds(F.min(start), F.max(end)).alias("wall_us"), F.count("*").alias("attempts"))


def ready_span(attempts: DataFrame, plan: list[str], stage: str, outcome: str, start: str, end: str, attempt: str, first_stage: str, last_stage: str, success: str) -> DataFrame:
    """Per plan, from the first start of one stage to the last end of another; null unless that last attempt succeeded.

    The last attempt is the greatest by end, start and id.
    """
    last = F.when(F.col(stage) == last_stage, F.struct(end, start, attempt))
    spans = attempts.groupBy(*plan).agg(F.min(F.when(F.col(stage) == first_stage, F.col(start))).alias("_from"), F.max(F.when(F.col(stage) == last_stage, F.col(end))).alias("_to"), F.max_by(F.col(outcome), last).alias("last_outcome"))
    return spans.select(*plan, "last_outcome", F.when((F.col("last_outcome") == success) & (F.col("_to") >= F.col("_from")), microseconds(F.col("_from"), F.col("_to"))).alias("ready_us"))


def one_success(attempts: DataFrame, by: list[str], outcome: str, success: str, duration: Column) -> DataFrame:
    """The duration of a group's only success; null without one or with several."""
    ok = F.col(outcome) == success
    return attempts.groupBy(*by).agg(F.when(F.count_if(ok) == 1, F.max(F.when(ok, duration))).alias("duration_us"), F.count_if(ok).alias("successes"))


def historical_summary(records: DataFrame, by: list[str], score: str, threshold: float, context: str, samples: str, single: str) -> DataFrame:
    """Mean score, passes, context tokens, and the median over all latency samples; a record without samples has its one latency."""
    each = records.groupBy(*by).agg(F.count("*").alias("records"), F.avg(score).alias("mean_score"), F.count_if(F.col(score) >= threshold).alias("passes"), F.sum(context).alias("context_total"), F.avg(context).alias("context_mean"))
    taken = records.select(*by, F.explode(F.coalesce(F.col(samples), F.array(F.col(single)))).alias("_ms")).groupBy(*by).agg(F.expr("percentile(_ms, 0.5)").alias("median_latency"), F.count("_ms").alias("latency_samples"))
    return each.join(taken, by, "left")


def rubric_score(raw: Column) -> Column:
    """A rubric item's score: 1 from 0.75, 0.5 from 0.25, else 0."""
    return F.when(raw >= 0.75, 1.0).when(raw >= 0.25, 0.5).otherwise(0.0)


def interval_union(spans: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """The time that a group's intervals cover together, and in how many unbroken stretches."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    numbered = spans.where(F.col(start) <= F.col(end)).withColumn("_new", new).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    islands = numbered.groupBy(*by, "_island").agg(F.min(start).alias("_a"), F.max(end).alias("_b"))
    return islands.groupBy(*by).agg(F.sum(F.col("_b") - F.col("_a")).alias("covered"), F.count("*").alias("stretches"))
