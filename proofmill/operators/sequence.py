"""Operators over ordered rows. Order is data: each takes its ordinal columns explicitly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordinals(rows: DataFrame, by: list[str], order: list, name: str = "ordinal") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def donor_fill(rows: DataFrame, by: list[str], order: list[str], value: str, ordinal: str) -> DataFrame:
    """A missing value comes from the next row that has one, else from the last before; ``donor`` is that row's ordinal."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col(ordinal).alias("o")))
    w = Window.partitionBy(*by).orderBy(*order)
    nxt = F.first(known, ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    prev = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    picked = rows.withColumn("_d", F.coalesce(nxt, prev))
    return picked.withColumn("filled", F.col("_d.v")).withColumn("donor", F.col("_d.o")).drop("_d")


def islands(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal values: island number, value and length per run."""
    w = Window.partitionBy(*by).orderBy(*order)
    change = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    numbered = rows.withColumn("_change", change).withColumn("island", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "island").agg(F.min(value).alias(value), F.count("*").alias("length"))


def outer_attempts(runs: DataFrame, by: list[str], value: str, max_retries: int) -> DataFrame:
    """Attempts with transport retries collapsed, from ``islands``; ``reappeared`` says that a value came back later."""
    per = max_retries + 1
    return runs.groupBy(*by).agg(F.sum(F.floor((F.col("length") + per - 1) / per)).cast("long").alias("outer_attempts"), (F.count("*") > F.count_distinct(value)).alias("reappeared"))


def overlaps(spans: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """The spans that reach into the next one."""
    nxt = F.lead(start).over(Window.partitionBy(*by).orderBy(start, end))
    return spans.withColumn("next_start", nxt).where(F.col("next_start") < F.col(end))


def gaps(spans: DataFrame, by: list[str], start: str, end: str, length: str) -> DataFrame:
    """What lies before, between and after the spans of each group, without empty gaps."""
    w = Window.partitionBy(*by).orderBy(start)
    before = spans.select(*by, F.lag(end, 1, 0).over(w).alias("gap_start"), F.col(start).alias("gap_end"))
    tail = spans.groupBy(*by).agg(F.max(end).alias("gap_start"), F.max(length).alias("gap_end"))
    return before.unionByName(tail).where(F.col("gap_start") < F.col("gap_end"))


def running_offset(rows: DataFrame, by: list[str], order: list[str], length: str, name: str = "offset") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(length).over(w), F.lit(0)))


def monotonic(clocks: list[str]) -> Column:
    """Whether clock columns never go back."""
    values = F.array(*clocks)
    pairs = F.zip_with(F.slice(values, 1, len(clocks) - 1), F.slice(values, 2, len(clocks) - 1), lambda a, b: a <= b)
    return F.forall(pairs, lambda ok: F.coalesce(ok, F.lit(False)))


def backoff_seconds(ordinal: Column, seeds: list[int]) -> Column:
    """Waits of the retries: the seeds, then the last seed doubled for each further retry."""
    table = F.array(*[F.lit(s) for s in seeds])
    return F.when(ordinal <= len(seeds), F.element_at(table, F.least(ordinal, F.lit(len(seeds))).cast("int"))).otherwise(
        F.call_function("shiftleft", F.lit(seeds[-1]).cast("long"), F.greatest(ordinal - len(seeds), F.lit(0)).cast("int"))
    ).cast("long")


def chain_breaks(rows: DataFrame, by: list[str], sequence: str, digest: str, predecessor: str) -> DataFrame:
    """Checkpoints that do not follow the one before: sequence not one more, or another predecessor hash."""
    w = Window.partitionBy(*by).orderBy(sequence)
    expected = F.coalesce(F.lag(sequence).over(w) + 1, F.lit(1))
    return rows.withColumn("_expected", expected).withColumn("_before", F.lag(digest).over(w)).where((F.col(sequence) != F.col("_expected")) | ~F.col(predecessor).eqNullSafe(F.col("_before"))).drop("_expected", "_before")


def invalid_transitions(events: DataFrame, by: list[str], order: list[str], state: str, event: str, table: DataFrame) -> DataFrame:
    """Events whose (state, event) is not in the table, or whose state is not what the event before led to.

    ``table`` (from_state, on_event, to_state) is a closed vocabulary of a few rows.
    """
    joined = events.join(F.broadcast(table), (F.col(state) == F.col("from_state")) & (F.col(event) == F.col("on_event")), "left")
    w = Window.partitionBy(*by).orderBy(*order)
    came = F.lag("to_state").over(w)
    first = F.row_number().over(w) == 1
    return joined.withColumn("_illegal", F.col("to_state").isNull()).withColumn("_jump", ~first & ~came.eqNullSafe(F.col(state))).where("_illegal or _jump").select(*events.columns, F.when(F.col("_illegal"), "illegal").otherwise("discontinuous").alias("violation"))


def budgeted(rows: DataFrame, by: list[str], order: list[str], reference: str, size: str, budget: int) -> DataFrame:
    """Each reference once, in order, until a byte budget is used up; the row that crosses it gets what is left."""
    w = Window.partitionBy(*by).orderBy(*order)
    once = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*by, reference).orderBy(*order))).where("_nth = 1").drop("_nth")
    used = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return once.withColumn("shown", F.least(F.col(size), F.greatest(F.lit(budget) - used, F.lit(0)))).where("shown > 0")


def running_total(rows: DataFrame, by: list[str], order: list[str], amount: str, ceiling: float) -> DataFrame:
    """A ledger replayed: the running sum and whether it still fits."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(amount).over(w)).withColumn("fits", F.col("running") <= ceiling)


def first_seen(rows: DataFrame, by: list[str], identity: str, content: Column, order: list[str]) -> DataFrame:
    """Disposition of each row: the first of an identity is kept, a repeat with equal content is a duplicate, other content a conflict."""
    w = Window.partitionBy(*by, identity).orderBy(*order)
    digest = F.sha2(content.cast("binary"), 256)
    return rows.withColumn("text_sha256", digest).withColumn("_first", F.first("text_sha256").over(w)).withColumn("_nth", F.row_number().over(w)).withColumn(
        "disposition", F.when(F.col("_nth") == 1, "kept").when(F.col("_first") == F.col("text_sha256"), "duplicate").otherwise("conflict")
    ).drop("_first", "_nth")


def labels(kept: DataFrame, by: list[str], is_source: Column, order: list[str]) -> DataFrame:
    """Sources are S1, S2, …, facts F1, F2, … in order."""
    n = F.row_number().over(Window.partitionBy(*by, is_source).orderBy(*order))
    return kept.withColumn("label", F.concat(F.when(is_source, "S").otherwise("F"), n.cast("string")))
