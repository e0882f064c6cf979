"""Aggregates that never pass a partial total off as a whole one.

Each total comes with a status: without measured values ``unavailable``; with some missing or partial
``measured_partial``; else ``measured_complete``. All are single group-bys with map-side partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPLETE, PARTIAL, UNAVAILABLE = "measured_complete", "measured_partial", "unavailable"


def status(measured: Column, gaps: Column) -> Column:
    """Coverage from the number of measured values and the number of missing or partial ones."""
    return F.when(measured == 0, UNAVAILABLE).when(gaps > 0, PARTIAL).otherwise(COMPLETE)


def _flags(proof: Column) -> dict[str, Column]:
    return {"measured": proof.isin(COMPLETE, PARTIAL), "partial": proof == PARTIAL, "missing": proof == UNAVAILABLE}


def stage_coverage(records: DataFrame, by: list[str], proof: str = "proof_status", billing: str | None = None) -> DataFrame:
    """Per group: record_count, measured_n, unavailable_n, billing_n and status."""
    f = _flags(F.col(proof))
    counts = records.groupBy(*by).agg(
        F.count("*").alias("record_count"), F.count_if(f["measured"]).alias("measured_n"), F.count_if(f["missing"]).alias("unavailable_n"),
        F.count_if(f["partial"]).alias("partial_n"), (F.count_if(F.col(billing)) if billing else F.lit(0).cast("long")).alias("billing_n"),
    )
    return counts.withColumn("status", status(F.col("measured_n"), F.col("unavailable_n") + F.col("partial_n"))).drop("partial_n")


def dimension_total(records: DataFrame, by: list[str], value: str, unavailable: Column) -> DataFrame:
    """Per group: the sum of a dimension's values, null if none is measured, and how complete it is."""
    sums = records.groupBy(*by).agg(F.sum(value).alias("value"), F.count(value).alias("measured_n"), F.count_if(unavailable).alias("unavailable_n"))
    return sums.withColumn("status", status(F.col("measured_n"), F.col("unavailable_n")))


def resource_dimension(records: DataFrame, by: list[str], value: str, ordinal: list[str], proof: str = "proof_status") -> DataFrame:
    """Per group the three aggregations of a resource: sum, maximum and the last measured value by ``ordinal``."""
    f = _flags(F.col(proof))
    x = F.when(f["measured"], F.col(value))
    out = records.groupBy(*by).agg(
        F.sum(x).alias("sum_value"), F.max(x).alias("maximum_value"), F.max_by(F.col(value), F.when(x.isNotNull(), F.struct(*ordinal))).alias("terminal_snapshot"),
        F.count(x).alias("measured_n"), F.count_if(f["missing"]).alias("unavailable_n"),
    )
    return out.withColumn("status", status(F.col("measured_n"), F.col("unavailable_n"))).withColumn("terminal_snapshot", F.when(F.col("measured_n") > 0, F.col("terminal_snapshot")))


def coverage_rollup(dimensions: DataFrame, by: list[str], state: str = "status") -> DataFrame:
    """One status over the statuses of several dimensions."""
    return dimensions.groupBy(*by).agg(
        F.when(~F.bool_or(F.col(state) != UNAVAILABLE), UNAVAILABLE).when(F.bool_or(F.col(state) != COMPLETE), PARTIAL).otherwise(COMPLETE).alias("status")
    )


def charge_by_currency(costs: DataFrame, by: list[str], amount: str, currency: str, basis: str, actual: str, proof: str) -> DataFrame:
    """Exact charges per currency; only records of the basis ``actual`` with a measured amount count."""
    counted = (F.col(basis) == actual) & F.col(proof).isin(COMPLETE, PARTIAL) & F.col(amount).isNotNull()
    out = costs.groupBy(*by, currency).agg(F.sum(F.when(counted, F.col(amount))).alias("charge"), F.count_if(counted).alias("charged_n"), F.count_if(F.col(proof) == UNAVAILABLE).alias("unavailable_n"))
    return out.withColumn("status", status(F.col("charged_n"), F.col("unavailable_n")))


def unpivot_dimensions(records: DataFrame, ids: list[str], dimensions: list[str], unavailable: str, not_applicable: str) -> DataFrame:
    """One row per record and dimension, with its value and whether it is covered, unavailable or not applicable."""
    long = records.unpivot([*ids, unavailable, not_applicable], dimensions, "dimension", "value")
    state = F.when(F.array_contains(unavailable, F.col("dimension")), "unavailable").when(F.array_contains(not_applicable, F.col("dimension")), "not_applicable").otherwise("covered")
    return long.withColumn("coverage", state).drop(unavailable, not_applicable)


def aggregate_measurements(records: DataFrame, keys: list[str], value: str, record_id: str) -> DataFrame:
    """Exact sums by a key with nullable parts: null keys are one group, a null member makes the sum null."""
    return records.groupBy(*keys).agg(
        F.when(F.count(value) == F.count("*"), F.sum(value)).alias("value"), F.count("*").alias("members"), F.min(record_id).alias("first_record"), F.max(record_id).alias("last_record")
    )


def reduce_accounting(records: DataFrame, by: list[str], billing: str, cost: str) -> DataFrame:
    """Whether billing and cost are complete: groups are non-empty by nature, a null flag is not complete."""
    return records.groupBy(*by).agg(
        F.count("*").alias("record_count"), F.bool_and(F.coalesce(F.col(billing), F.lit(False))).alias("billing_complete"), F.bool_and(F.coalesce(F.col(cost), F.lit(False))).alias("cost_complete")
    )


def budget_vector(entries: DataFrame, owner: str, dimension: str, amount: str, sign: Column) -> DataFrame:
    """Balance per owner and dimension of a ledger of additions and subtractions."""
    return entries.groupBy(owner, dimension).agg(F.sum(sign * F.col(amount)).alias("balance"))


def usage_closure(usage: DataFrame, prompt: str, completion: str, total: str) -> DataFrame:
    """The records whose parts do not add up to their total; null parts violate too."""
    return usage.where(~F.coalesce(F.col(prompt) + F.col(completion) == F.col(total), F.lit(False)))


def worst_state(states: DataFrame, by: list[str], state: str, precedence: list[str]) -> DataFrame:
    """The first of ``precedence`` that a group has; a state that is not listed comes last."""
    rank = F.array_position(F.array(*[F.lit(s) for s in precedence]), F.col(state))
    return states.groupBy(*by).agg(F.min_by(F.col(state), F.when(rank == 0, len(precedence) + 1).otherwise(rank)).alias("state"))
