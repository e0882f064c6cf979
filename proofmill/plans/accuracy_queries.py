"""Accuracy, paired comparison and decisions over labelled documents: quality is one arm, not toxic the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.functions import exact
from proofmill.operators import accuracy
from proofmill.plans.registry import query, table

_Z = f"{exact.WILSON_Z}::DOUBLE"


def _wilson_sql(sign: str) -> str:
    return f"round((p + {_Z}*{_Z}/(2*n) {sign} {_Z}*sqrt(p*(1-p)/n + {_Z}*{_Z}/(4*n*n))) / (1 + {_Z}*{_Z}/n), 6)"


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")


@query(
    f"""
WITH c AS (SELECT lang, quality = 1 AS ok FROM labels JOIN documents USING (doc_id)),
g AS (SELECT CASE WHEN grouping(lang) = 1 THEN 'total' ELSE lang END AS stratum, count(*) AS cases, count(ok) AS judged, count_if(ok) AS correct FROM c GROUP BY ROLLUP (lang)),
w AS (SELECT *, judged::DOUBLE AS n, correct::DOUBLE / judged AS p FROM g)
SELECT stratum, cases, judged, correct::BIGINT AS correct, {_wilson_sql("-")} AS wilson_lower, {_wilson_sql("+")} AS wilson_upper FROM w"""
)
def accuracy_by_stratum(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy with Wilson bounds per language and over all."""
    ok = accuracy.binary_outcome(F.lit(True), F.col("quality").isNotNull(), F.col("quality"), F.lit(1))
    return accuracy.accuracy_slices(_labelled(spark, d).withColumn("ok", ok), "lang", "ok")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = _labelled(spark, d)
    left = rows.select("doc_id", (F.col("quality") == 1).alias("ok"))
    right = rows.select("doc_id", (F.col("toxic") == 0).alias("ok"))
    langs = rows.select("doc_id", "lang")
    return accuracy.paired(left, right, "doc_id", "ok").join(langs, "doc_id")


@query("""
SELECT lang, count_if(quality = 1 AND toxic = 0)::BIGINT AS "both", count_if(quality = 1 AND toxic = 1)::BIGINT AS left_only, count_if(quality = 0 AND toxic = 0)::BIGINT AS right_only,
       count_if(quality = 0 AND toxic = 1)::BIGINT AS neither, 0::BIGINT AS unjudged, true AS same_cases
FROM labels JOIN documents USING (doc_id) GROUP BY lang""")
def paired_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """The 2 x 2 table of two arms per language."""
    return accuracy.paired_counts(_pairs(spark, d), ["lang"])


@query()
def mcnemar_exact(spark: SparkSession, d: str) -> DataFrame:
    """Exact probability and delta per source and over all; numerators pass 38 digits, so there is no SQL."""
    rows = _labelled(spark, d)
    p = accuracy.paired(rows.select("doc_id", (F.col("quality") == 1).alias("ok")), rows.select("doc_id", (F.col("toxic") == 0).alias("ok")), "doc_id", "ok").join(rows.select("doc_id", "source"), "doc_id")
    return accuracy.pair_statistics(accuracy.paired_counts(p, ["source"]))


@query("""
WITH c AS (SELECT lang, count_if(quality = 1) AS a, count_if(toxic = 0) AS b, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang)
SELECT lang, ((a - b) // greatest(gcd(abs(a - b), n), 1))::BIGINT AS delta_num, (n // greatest(gcd(abs(a - b), n), 1))::BIGINT AS delta_den FROM c""")
def accuracy_delta(spark: SparkSession, d: str) -> DataFrame:
    """D3: the signed exact difference of two accuracies."""
    c = _labelled(spark, d).groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("a"), F.count_if(F.col("toxic") == 0).alias("b"), F.count("*").alias("n"))
    delta = exact.signed_delta(F.col("a"), F.col("n"), F.col("b"), F.col("n"))
    return c.select("lang", delta["num"].alias("delta_num"), delta["den"].alias("delta_den"))


@query("""
WITH c AS (SELECT l_returnflag, sum(l_quantity::BIGINT) AS s, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_returnflag, n AS cases, (s // gcd(s::BIGINT, 50 * n))::BIGINT AS mean_num, (50 * n // gcd(s::BIGINT, 50 * n))::BIGINT AS mean_den FROM c""")
def exact_mean_rational(spark: SparkSession, d: str) -> DataFrame:
    """An exact mean of fractions of fifty."""
    rows = table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").cast("long").alias("num"), F.lit(50).cast("long").alias("den"))
    return accuracy.exact_mean(rows, ["l_returnflag"], "num", "den")


@query("""
WITH c AS (SELECT source, count(*) AS n, count_if(quality = 1) AS k, dense_rank() OVER (ORDER BY source) AS o FROM labels JOIN documents USING (doc_id) GROUP BY source)
SELECT a.source AS left_source, b.source AS right_source, a.k::BIGINT AS left_k, b.k::BIGINT AS right_k, a.n AS left_n, b.n AS right_n,
  concat_ws(',', CASE WHEN NOT (a.n >= 5 AND b.n >= 5) THEN 'complete_equal_coverage' END, CASE WHEN NOT abs(a.k::DOUBLE / a.n - b.k::DOUBLE / b.n) >= 0.05 THEN 'minimum_accuracy_delta' END) AS limitations
FROM c a JOIN c b ON a.o < b.o""")
def provider_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of sources with what limits their comparison."""
    c = _labelled(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("k"))
    pairs = accuracy.arm_pairs(c, "source")
    rate = lambda side: F.col(f"{side}_k").cast("double") / F.col(f"{side}_n")
    found = accuracy.limitations({"complete_equal_coverage": (F.col("left_n") >= 5) & (F.col("right_n") >= 5), "minimum_accuracy_delta": F.abs(rate("left") - rate("right")) >= 0.05})
    return pairs.select("left_source", "right_source", "left_k", "right_k", "left_n", "right_n", F.array_join(found, ",").alias("limitations"))


@query("""
WITH c AS (SELECT source, count(*) AS n, count_if(quality = 1) AS k FROM labels JOIN documents USING (doc_id) GROUP BY source), r AS (SELECT source, (k::DECIMAL(38,0) / n)::DOUBLE AS s FROM c), b AS (SELECT max(s) AS s FROM r)
SELECT CASE WHEN count(*) = 1 THEN min(source) END AS leader, count(*) AS tied FROM r WHERE abs(s - (SELECT s FROM b)) < 1e-12""")
def leader_decision(spark: SparkSession, d: str) -> DataFrame:
    """The unique source of the highest exact accuracy."""
    c = _labelled(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("k"))
    return accuracy.leader(c, "source", "k", "n")


@query("""
WITH c AS (SELECT source, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source)
SELECT (SELECT string_agg(source, ',' ORDER BY source) FROM c WHERE chars = (SELECT min(chars) FROM c)) AS lowest, (SELECT CASE WHEN count(*) = 1 THEN min(source) END FROM c WHERE chars = (SELECT max(chars) FROM c)) AS highest""")
def context_extremes(spark: SparkSession, d: str) -> DataFrame:
    """All sources of the lowest context, and the unique one of the highest."""
    c = table(spark, d, "documents").groupBy("source").agg(F.sum("n_chars").alias("chars"))
    low, high = accuracy.lowest(c, "source", "chars").withColumn("_j", F.lit(1)), accuracy.unique_highest(c, "source", "chars").withColumn("_j", F.lit(1))
    return low.join(high, "_j").drop("_j")


@query("""
WITH c AS (SELECT source, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source), m AS (SELECT max(chars) AS m FROM c)
SELECT source, floor(((m - chars) * 200 + m)::DECIMAL(38,0) / (2 * m))::BIGINT AS reduction_percent FROM c, m""")
def context_reduction(spark: SparkSession, d: str) -> DataFrame:
    """By how many percent a source's context is below the largest, half up."""
    c = table(spark, d, "documents").groupBy("source").agg(F.sum("n_chars").alias("chars"))
    return c.join(F.broadcast(c.agg(F.max("chars").alias("m")).withColumn("_j", F.lit(1))), F.lit(1) == F.col("_j")).select("source", accuracy.context_reduction(F.col("chars"), F.col("m")).alias("reduction_percent"))


@query("""
WITH a AS (SELECT event_type AS k, count(*) AS v FROM events GROUP BY 1), b AS (SELECT event_type AS k, count(*) AS v FROM events WHERE event_id >= 0 GROUP BY 1)
SELECT bool_and(a.k IS NOT NULL AND b.k IS NOT NULL AND a.v IS NOT DISTINCT FROM b.v) AS comparable, CASE WHEN bool_and(a.k IS NOT NULL AND b.k IS NOT NULL AND a.v IS NOT DISTINCT FROM b.v) THEN 'claim' END AS claim FROM a FULL JOIN b ON a.k = b.k""")
def control_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Claims stand only where every control agrees."""
    events = table(spark, d, "events")
    count = lambda rows: rows.groupBy(F.col("event_type").alias("k")).agg(F.count("*").alias("v"))
    return accuracy.control_comparison(count(events), count(events.where("event_id >= 0")), "k", "v", F.lit("claim"))


@query("""
WITH c AS (SELECT lang, count_if(quality = 1) AS a, count_if(toxic = 0) AS b FROM labels JOIN documents USING (doc_id) GROUP BY lang)
SELECT lang, CASE WHEN abs(a - b) <= 5 THEN 'near_parity' WHEN a > b THEN 'left_ahead' ELSE 'right_ahead' END AS decision FROM c""")
def near_parity(spark: SparkSession, d: str) -> DataFrame:
    """Decisions by margin."""
    c = _labelled(spark, d).groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("a"), F.count_if(F.col("toxic") == 0).alias("b"))
    return c.select("lang", accuracy.near_parity(F.col("a") - F.col("b"), F.lit(5)).alias("decision"))


@query("""
WITH c AS (SELECT lang, count_if(quality = 1 AND toxic = 1) AS l, count_if(quality = 0 AND toxic = 0) AS r, count_if(quality = 1) AS a, count_if(toxic = 0) AS b, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang),
d AS (SELECT *, (a - b)::DOUBLE / n AS delta FROM c)
SELECT lang, concat_ws(',', CASE WHEN n < 50 THEN 'complete_equal_coverage' END, CASE WHEN abs(delta) < 0.02 THEN 'minimum_accuracy_delta' END) AS failed_predicates,
       CASE WHEN n < 50 OR abs(delta) < 0.02 OR delta = 0 THEN NULL WHEN delta > 0 THEN 'left' ELSE 'right' END AS leader FROM d""")
def pair_decision(spark: SparkSession, d: str) -> DataFrame:
    """Whom a pair favours by coverage and difference alone; ``exact_pair_decision`` has the exact probability too."""
    c = _labelled(spark, d).groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("a"), F.count_if(F.col("toxic") == 0).alias("b"), F.count("*").alias("n"))
    rows = c.withColumn("delta", (F.col("a") - F.col("b")).cast("double") / F.col("n")).withColumn("p", F.lit(1.0)).withColumn("complete", F.col("n") >= 50)
    return accuracy.pair_decision(rows, 0.02, 1.0, "delta", "p", "complete").select("lang", "failed_predicates", "leader")


@query("""
SELECT lang, source, count_if(quality = 1)::BIGINT AS correct, count(*) AS total, count_if(quality = 0)::BIGINT AS incorrect FROM labels JOIN documents USING (doc_id) GROUP BY ALL""")
def type_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Correct, total and incorrect per arm and type."""
    return _labelled(spark, d).groupBy("lang", "source").agg(F.count_if(F.col("quality") == 1).alias("correct"), F.count("*").alias("total"), F.count_if(F.col("quality") == 0).alias("incorrect"))


@query("""
WITH c AS (SELECT doc_id, lang, CASE WHEN doc_id % 10 <> 0 THEN quality = 1 END AS a, CASE WHEN doc_id % 7 <> 0 THEN toxic = 0 END AS b FROM labels JOIN documents USING (doc_id))
SELECT lang, count(a) AS judged_a, count_if(a)::BIGINT AS correct_a, count(b) AS judged_b, count_if(b)::BIGINT AS correct_b, count_if(a AND NOT b)::BIGINT AS lost, count_if(b AND NOT a)::BIGINT AS gained,
       coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (a IS NULL AND b IS NULL), '') AS unjudged FROM c GROUP BY lang""")
def study_summary(spark: SparkSession, d: str) -> DataFrame:
    """Judged and correct per arm, flips, and the cases that nobody judged."""
    c = _labelled(spark, d).select("doc_id", "lang", F.when(F.col("doc_id") % 10 != 0, F.col("quality") == 1).alias("a"), F.when(F.col("doc_id") % 7 != 0, F.col("toxic") == 0).alias("b"))
    a, b = F.col("a"), F.col("b")
    return c.groupBy("lang").agg(
        F.count("a").alias("judged_a"), F.count_if(a).alias("correct_a"), F.count("b").alias("judged_b"), F.count_if(b).alias("correct_b"), F.count_if(a & ~b).alias("lost"), F.count_if(b & ~a).alias("gained"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(a.isNull() & b.isNull(), F.col("doc_id")))), lambda x: x.cast("string")), ",").alias("unjudged"),
    )
