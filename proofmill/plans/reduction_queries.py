"""Coverage-aware totals, resources, costs, durations and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.functions import exact
from proofmill.operators import coverage, durations
from proofmill.plans.registry import query, table

_PROOF = "CASE {} WHEN 'A' THEN 'measured_complete' WHEN 'R' THEN 'measured_partial' ELSE 'unavailable' END"


def _usage(spark: SparkSession, d: str) -> DataFrame:
    """Line items as usage records: the return flag says how well a record is measured."""
    rows = table(spark, d, "lineitem")
    proof = F.when(F.col("l_returnflag") == "A", coverage.COMPLETE).when(F.col("l_returnflag") == "R", coverage.PARTIAL).otherwise(coverage.UNAVAILABLE)
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return rows.withColumn("proof_status", proof).withColumn("tokens", F.when(proof != coverage.UNAVAILABLE, F.col("l_quantity").cast("long"))).withColumn("cents", cents)


_USAGE = f"SELECT *, {_PROOF.format('l_returnflag')} AS proof, CASE WHEN l_returnflag <> 'N' THEN l_quantity::BIGINT END AS tokens, round(l_extendedprice * 100)::BIGINT AS cents FROM lineitem"


@query(f"""
SELECT l_linestatus, count(*) AS record_count, count_if(proof <> 'unavailable')::BIGINT AS measured_n, count_if(proof = 'unavailable')::BIGINT AS unavailable_n, count_if(l_tax > 0)::BIGINT AS billing_n,
       CASE WHEN count_if(proof <> 'unavailable') = 0 THEN 'unavailable' WHEN count_if(proof <> 'measured_complete') > 0 THEN 'measured_partial' ELSE 'measured_complete' END AS status
FROM ({_USAGE}) GROUP BY 1""")
def stage_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Usage coverage of a stage."""
    return coverage.stage_coverage(_usage(spark, d).withColumn("billed", F.col("l_tax") > 0), ["l_linestatus"], billing="billed")


@query(f"""
SELECT l_suppkey % 10 AS stage, l_returnflag, sum(tokens)::DOUBLE AS value, count(tokens) AS measured_n, count_if(proof = 'unavailable')::BIGINT AS unavailable_n,
       CASE WHEN count(tokens) = 0 THEN 'unavailable' WHEN count_if(proof = 'unavailable') > 0 THEN 'measured_partial' ELSE 'measured_complete' END AS status
FROM ({_USAGE}) GROUP BY ALL""")
def coverage_sum(spark: SparkSession, d: str) -> DataFrame:
    """A dimension's total never hides what is missing."""
    rows = _usage(spark, d).withColumn("stage", F.col("l_suppkey") % 10)
    return coverage.dimension_total(rows, ["stage", "l_returnflag"], "tokens", F.col("proof_status") == coverage.UNAVAILABLE).withColumn("value", F.col("value").cast("double"))


@query("""
SELECT event_type, sum(round(value * 100)::BIGINT) FILTER (event_type <> 'error')::DOUBLE AS sum_value, max(round(value * 100)::BIGINT) FILTER (event_type <> 'error')::DOUBLE AS maximum_value,
       CASE WHEN event_type <> 'error' THEN arg_max(round(value * 100)::BIGINT, event_id)::DOUBLE END AS terminal_snapshot, count_if(event_type <> 'error')::BIGINT AS measured_n, count_if(event_type = 'error')::BIGINT AS unavailable_n,
       CASE WHEN event_type = 'error' THEN 'unavailable' ELSE 'measured_complete' END AS status
FROM events GROUP BY event_type""")
def resource_three_ways(spark: SparkSession, d: str) -> DataFrame:
    """Sum, maximum and terminal snapshot of a resource."""
    rows = table(spark, d, "events").select("event_type", "event_id", F.round(F.col("value") * 100).cast("double").alias("v"), F.when(F.col("event_type") == "error", coverage.UNAVAILABLE).otherwise(coverage.COMPLETE).alias("proof_status"))
    return coverage.resource_dimension(rows, ["event_type"], "v", ["event_id"])


@query(f"""
WITH s AS (SELECT l_linestatus, l_suppkey % 7 AS dim, CASE WHEN count(tokens) = 0 THEN 'unavailable' WHEN count_if(proof = 'unavailable') > 0 THEN 'measured_partial' ELSE 'measured_complete' END AS status FROM ({_USAGE}) GROUP BY ALL)
SELECT l_linestatus, CASE WHEN NOT bool_or(status <> 'unavailable') THEN 'unavailable' WHEN bool_or(status <> 'measured_complete') THEN 'measured_partial' ELSE 'measured_complete' END AS status FROM s GROUP BY 1""")
def coverage_rollup(spark: SparkSession, d: str) -> DataFrame:
    """One status over several dimensions."""
    rows = _usage(spark, d).withColumn("dim", F.col("l_suppkey") % 7)
    return coverage.coverage_rollup(coverage.dimension_total(rows, ["l_linestatus", "dim"], "tokens", F.col("proof_status") == coverage.UNAVAILABLE), ["l_linestatus"])


@query("""
SELECT o_orderpriority AS currency, sum(round(o_totalprice * 100)::BIGINT) FILTER (o_orderstatus = 'F')::BIGINT AS charge, count_if(o_orderstatus = 'F')::BIGINT AS charged_n, count_if(o_orderstatus = 'P')::BIGINT AS unavailable_n,
       CASE WHEN count_if(o_orderstatus = 'F') = 0 THEN 'unavailable' WHEN count_if(o_orderstatus = 'P') > 0 THEN 'measured_partial' ELSE 'measured_complete' END AS status
FROM orders GROUP BY 1""")
def cost_by_currency(spark: SparkSession, d: str) -> DataFrame:
    """Exact charges per currency, actual ones only."""
    rows = table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("currency"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.when(F.col("o_orderstatus") == "F", "actual").otherwise("estimate").alias("basis"),
        F.when(F.col("o_orderstatus") == "P", coverage.UNAVAILABLE).otherwise(coverage.COMPLETE).alias("proof"),
    )
    return coverage.charge_by_currency(rows, [], "cents", "currency", "basis", "actual", "proof")


@query(f"""
SELECT l_returnflag, l_linestatus, CASE WHEN count(tokens) = count(*) THEN sum(tokens)::DOUBLE END AS value, count(*) AS members, min(l_orderkey) AS first_record, max(l_orderkey) AS last_record
FROM ({_USAGE}) GROUP BY ALL""")
def measurement_groups(spark: SparkSession, d: str) -> DataFrame:
    """A2 A4: sums that are null where a member is."""
    return coverage.aggregate_measurements(_usage(spark, d), ["l_returnflag", "l_linestatus"], "tokens", "l_orderkey").withColumn("value", F.col("value").cast("double"))


@query("""
SELECT o_orderpriority, count(*) AS record_count, bool_and(o_orderstatus <> 'P') AS billing_complete, bool_and(o_totalprice > 0) AS cost_complete FROM orders GROUP BY 1""")
def accounting_completeness(spark: SparkSession, d: str) -> DataFrame:
    """A4: whether all records of a group are billed and costed."""
    rows = table(spark, d, "orders").withColumn("billing", F.col("o_orderstatus") != "P").withColumn("cost", F.col("o_totalprice") > 0)
    return coverage.reduce_accounting(rows, ["o_orderpriority"], "billing", "cost")


@query("""
WITH r AS (SELECT *, l_returnflag = 'N' AS un, l_returnflag = 'R' AS na FROM lineitem),
u AS (SELECT dimension, CASE WHEN un AND dimension IN ('discount', 'tax') THEN 'unavailable' WHEN na AND dimension = 'tax' THEN 'not_applicable' ELSE 'covered' END AS coverage, v
      FROM (SELECT un, na, unnest(['quantity', 'price', 'discount', 'tax']) AS dimension, unnest([l_quantity::BIGINT, round(l_extendedprice * 100)::BIGINT, round(l_discount * 100)::BIGINT, round(l_tax * 100)::BIGINT]) AS v FROM r))
SELECT dimension, coverage, count(*) AS records, sum(v)::BIGINT AS total FROM u GROUP BY ALL""")
def unpivot_dimensions(spark: SparkSession, d: str) -> DataFrame:
    """A3: one row per record and dimension, by coverage."""
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", F.col("l_quantity").cast("long").alias("quantity"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("price"), F.round(F.col("l_discount") * 100).cast("long").alias("discount"), F.round(F.col("l_tax") * 100).cast("long").alias("tax"),
        F.when(F.col("l_returnflag") == "N", F.array(F.lit("discount"), F.lit("tax"))).otherwise(F.array().cast("array<string>")).alias("unavailable"), F.when(F.col("l_returnflag") == "R", F.array(F.lit("tax"))).otherwise(F.array().cast("array<string>")).alias("na"),
    )
    long = coverage.unpivot_dimensions(rows, ["l_orderkey"], ["quantity", "price", "discount", "tax"], "unavailable", "na")
    return long.groupBy("dimension", "coverage").agg(F.count("*").alias("records"), F.sum("value").alias("total"))


@query("""
SELECT o_custkey % 20 AS owner, o_orderpriority AS dimension, sum(CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END * round(o_totalprice * 100)::BIGINT)::BIGINT AS balance FROM orders GROUP BY ALL""")
def budget_balance(spark: SparkSession, d: str) -> DataFrame:
    """Additions and subtractions per owner and dimension."""
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("owner"), F.col("o_orderpriority").alias("dimension"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), "o_orderstatus")
    return coverage.budget_vector(rows, "owner", "dimension", "cents", F.when(F.col("o_orderstatus") == "F", -1).otherwise(1))


@query("""
SELECT o_custkey, CASE min(CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END) WHEN 1 THEN 'P' WHEN 2 THEN 'O' ELSE 'F' END AS state FROM orders GROUP BY 1""")
def worst_state(spark: SparkSession, d: str) -> DataFrame:
    """The worst state of a group by precedence."""
    return coverage.worst_state(table(spark, d, "orders"), ["o_custkey"], "o_orderstatus", ["P", "O", "F"])


@query("""
SELECT lang, sum(n_chars)::BIGINT AS total, count(*) AS cases, (floor((sum(n_chars) * 20 + count(*))::DECIMAL(38,0) / (2 * count(*)))::BIGINT::DOUBLE / 10) AS mean_1dp FROM documents GROUP BY lang""")
def context_mean(spark: SparkSession, d: str) -> DataFrame:
    """The mean to one decimal, half up, from integers."""
    sums = table(spark, d, "documents").groupBy("lang").agg(F.sum("n_chars").alias("total"), F.count("*").alias("cases"))
    return sums.withColumn("mean_1dp", exact.half_up(F.col("total"), F.col("cases"), 1).cast("double"))


_GAPS = "SELECT event_type, user_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS us FROM events"


def _event_gaps(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").withColumn("us", durations.microseconds(before, F.col("ts")))


@query(f"""
SELECT event_type, count(us) AS "count", median(us)::DOUBLE AS median_us, quantile_disc(us, 0.95)::BIGINT AS p95_us, max(us)::BIGINT AS max_us FROM ({_GAPS}) WHERE us IS NOT NULL GROUP BY 1""")
def duration_summary(spark: SparkSession, d: str) -> DataFrame:
    """Count, exact median, nearest-rank p95 and maximum."""
    return durations.duration_summary(_event_gaps(spark, d), ["event_type"], "us")


@query("""
SELECT user_id, (epoch_us(max(ts)) - epoch_us(min(ts)))::BIGINT AS wall_us, count(*) AS attempts FROM events GROUP BY 1""")
def case_wall_time(spark: SparkSession, d: str) -> DataFrame:
    """Last end minus first start."""
    return durations.wall_time(table(spark, d, "events"), ["user_id"], "ts", "ts")


@query("""
WITH s AS (SELECT user_id, min(ts) FILTER (event_type = 'signup') AS a, max(ts) FILTER (event_type = 'purchase') AS b, arg_max(CASE WHEN value > 10 THEN 'ok' ELSE 'failed' END, (ts, event_id)) FILTER (event_type = 'purchase') AS last_outcome FROM events GROUP BY 1)
SELECT user_id, last_outcome, CASE WHEN last_outcome = 'ok' AND b >= a THEN (epoch_us(b) - epoch_us(a))::DOUBLE END AS ready_us FROM s""")
def ready_span(spark: SparkSession, d: str) -> DataFrame:
    """From the first start of a stage to the last success of another."""
    rows = table(spark, d, "events").withColumn("outcome", F.when(F.col("value") > 10, "ok").otherwise("failed"))
    return durations.ready_span(rows, ["user_id"], "event_type", "outcome", "ts", "ts", "event_id", "signup", "purchase", "ok").withColumn("ready_us", F.col("ready_us").cast("double"))


@query("""
SELECT o_custkey, CASE WHEN count_if(o_orderstatus = 'P') = 1 THEN max(round(o_totalprice * 100)) FILTER (o_orderstatus = 'P')::DOUBLE END AS duration_us, count_if(o_orderstatus = 'P')::BIGINT AS successes FROM orders GROUP BY 1""")
def one_success_duration(spark: SparkSession, d: str) -> DataFrame:
    """Exactly one success, or nothing."""
    return durations.one_success(table(spark, d, "orders"), ["o_custkey"], "o_orderstatus", "P", F.round(F.col("o_totalprice") * 100))


@query("""
WITH l AS (SELECT source, n_chars AS ms FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT source, unnest([n_chars // 2, n_chars]) FROM documents WHERE doc_id % 3 = 0),
r AS (SELECT source, count(*) AS records, round(avg((doc_id % 5) / 4.0), 9) AS mean_score, count_if((doc_id % 5) / 4.0 >= 0.5)::BIGINT AS passes, sum(n_chars)::BIGINT AS context_total, round(avg(n_chars), 6) AS context_mean FROM documents GROUP BY 1)
SELECT r.*, m.median_latency, m.latency_samples FROM r JOIN (SELECT source, median(ms)::DOUBLE AS median_latency, count(*) AS latency_samples FROM l GROUP BY 1) m USING (source)""")
def historical_summary(spark: SparkSession, d: str) -> DataFrame:
    """Scores, passes, context and latency samples per arm."""
    half = F.floor(F.col("n_chars") / 2).cast("long")
    rows = table(spark, d, "documents").select("source", ((F.col("doc_id") % 5) / 4.0).alias("score"), "n_chars", F.when(F.col("doc_id") % 3 == 0, F.array(half, F.col("n_chars"))).alias("samples"))
    out = durations.historical_summary(rows, ["source"], "score", 0.5, "n_chars", "samples", "n_chars")
    return out.withColumn("mean_score", F.round("mean_score", 9)).withColumn("context_mean", F.round("context_mean", 6))


@query("""
SELECT event_type, count(*) AS items, sum(CASE WHEN value / 100 >= 0.75 THEN 2 WHEN value / 100 >= 0.25 THEN 1 ELSE 0 END)::BIGINT AS half_points FROM events GROUP BY 1""")
def rubric_scores(spark: SparkSession, d: str) -> DataFrame:
    """Rubric scores in buckets."""
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("items"), F.sum((durations.rubric_score(F.col("value") / 100) * 2).cast("long")).alias("half_points"))


@query("""
SELECT o_orderpriority, count(*) AS total, count_if(o_orderstatus = 'F')::BIGINT AS finished, count_if(o_orderstatus = 'O')::BIGINT AS open, count_if(o_orderstatus = 'P')::BIGINT AS pending, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1""")
def completion_counters(spark: SparkSession, d: str) -> DataFrame:
    """Conditional counters per group; ``run_counters`` has all of a run."""
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(
        F.count("*").alias("total"), F.count_if(s == "F").alias("finished"), F.count_if(s == "O").alias("open"), F.count_if(s == "P").alias("pending"), F.count_distinct("o_custkey").alias("customers")
    )


@query("""
WITH t AS (SELECT event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY ROLLUP (event_type)), c AS (SELECT unnest(['signup', 'view', 'click', 'purchase', 'refund', 'error', NULL]) AS category, unnest(range(7)) AS ordinal)
SELECT coalesce(category, 'total') AS category, ordinal::INT AS ordinal, coalesce(n, 0) AS n, coalesce(cents, 0) AS cents FROM c LEFT JOIN t ON category IS NOT DISTINCT FROM event_type""")
def category_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals in a fixed order of categories, empty ones kept."""
    sums = table(spark, d, "events").rollup("event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"), F.grouping("event_type").alias("_all"))
    sums = sums.select(F.when(F.col("_all") == 1, "total").otherwise(F.col("event_type")).alias("category"), "n", "cents")
    order = spark.createDataFrame(list(zip(["signup", "view", "click", "purchase", "refund", "error", "total"], range(7), strict=True)), "category string, ordinal int")
    return F.broadcast(order).join(sums, "category", "left").select("category", "ordinal", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("cents", F.lit(0)).alias("cents"))


@query("""
SELECT 'max' AS rule, max(n)::BIGINT AS observed, max(n) <= 1000 AS within FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)""")
def observed_ceiling(spark: SparkSession, d: str) -> DataFrame:
    """The largest observed count against its ceiling."""
    counts = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return counts.agg(F.lit("max").alias("rule"), F.max("n").alias("observed"), (F.max("n") <= 1000).alias("within"))


@query("""
SELECT axis, key, count(*) AS records, sum(cents)::BIGINT AS cents FROM (
  SELECT 'order' AS axis, o_orderstatus AS key, round(o_totalprice * 100)::BIGINT AS cents FROM orders UNION ALL
  SELECT 'event', event_type, round(value * 100)::BIGINT FROM events UNION ALL
  SELECT 'document', lang, n_chars FROM documents UNION ALL SELECT 'account', c_mktsegment, round(c_acctbal * 100)::BIGINT FROM customer) GROUP BY ALL""")
def axis_projection(spark: SparkSession, d: str) -> DataFrame:
    """Four axes of records under one schema."""
    cents = lambda c: F.round(F.col(c) * 100).cast("long").alias("cents")
    parts = [
        table(spark, d, "orders").select(F.lit("order").alias("axis"), F.col("o_orderstatus").alias("key"), cents("o_totalprice")),
        table(spark, d, "events").select(F.lit("event").alias("axis"), F.col("event_type").alias("key"), cents("value")),
        table(spark, d, "documents").select(F.lit("document").alias("axis"), F.col("lang").alias("key"), F.col("n_chars").alias("cents")),
        table(spark, d, "customer").select(F.lit("account").alias("axis"), F.col("c_mktsegment").alias("key"), cents("c_acctbal")),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("axis", "key").agg(F.count("*").alias("records"), F.sum("cents").alias("cents"))


@query("""
WITH s AS (SELECT l_orderkey AS ctx, l_partkey AS a, l_partkey + l_quantity::BIGINT AS b FROM lineitem), m AS (SELECT *, max(b) OVER (PARTITION BY ctx ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY ctx ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m), g AS (SELECT ctx, island, min(a) AS a, max(b) AS b FROM i GROUP BY ALL)
SELECT ctx, sum(b - a)::BIGINT AS covered, count(*) AS stretches FROM g GROUP BY ctx""")
def interval_union(spark: SparkSession, d: str) -> DataFrame:
    """What intervals cover together."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("ctx"), F.col("l_partkey").alias("a"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("b"))
    return durations.interval_union(rows, ["ctx"], "a", "b")
