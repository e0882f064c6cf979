"""Integrity rules and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.operators import coverage, joining, rules
from proofmill.plans.registry import query, table


@query("""
SELECT 'orders.customer' AS rule_id, o_orderkey::VARCHAR AS evidence_ref, 'unresolved' AS code FROM orders WHERE o_custkey % 50 = 0 UNION ALL
SELECT 'lineitem.order', l_orderkey::VARCHAR, 'unresolved' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL
SELECT 'labels.document', doc_id::VARCHAR, 'unresolved' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def fk_violations(spark: SparkSession, d: str) -> DataFrame:
    """References that nothing answers; every fiftieth customer is taken away first."""
    customers = table(spark, d, "customer").where("c_custkey % 50 <> 0")
    found = [
        rules.violations("orders.customer", joining.orphan_keys(table(spark, d, "orders"), customers, "o_custkey", "c_custkey"), F.col("o_orderkey"), "unresolved"),
        rules.violations("lineitem.order", joining.orphan_keys(table(spark, d, "lineitem"), table(spark, d, "orders"), "l_orderkey", "o_orderkey"), F.col("l_orderkey"), "unresolved"),
        rules.violations("labels.document", joining.orphan_keys(table(spark, d, "labels"), table(spark, d, "documents"), "doc_id", "doc_id"), F.col("doc_id"), "unresolved"),
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("""
SELECT 'orders.customer' AS rule_id, 0 AS ordinal, (SELECT count(*) FROM orders WHERE o_custkey % 50 = 0)::BIGINT AS violations, 'invalid' AS verdict UNION ALL
SELECT 'lineitem.order', 1, 0, 'valid' UNION ALL SELECT 'documents.license', 2, (SELECT count(*) FROM documents WHERE contains(text, 'Licensed under'))::BIGINT, 'invalid' UNION ALL SELECT 'never.run', 3, 0, 'missing'""")
def rule_profile(spark: SparkSession, d: str) -> DataFrame:
    """§2.10b F17 I5: a closed profile of rules, of which one was not run."""
    customers = table(spark, d, "customer").where("c_custkey % 50 <> 0")
    ran = {
        "orders.customer": rules.violations("orders.customer", joining.orphan_keys(table(spark, d, "orders"), customers, "o_custkey", "c_custkey"), F.col("o_orderkey"), "unresolved"),
        "lineitem.order": rules.violations("lineitem.order", joining.orphan_keys(table(spark, d, "lineitem"), table(spark, d, "orders"), "l_orderkey", "o_orderkey"), F.col("l_orderkey"), "unresolved"),
        "documents.license": rules.violations("documents.license", rules.forbidden(table(spark, d, "documents"), "text", ["Licensed under"]), F.col("doc_id"), "forbidden_value"),
    }
    return rules.profile(ran, ["orders.customer", "lineitem.order", "documents.license", "never.run"])


@query("SELECT l_orderkey, n AS members FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) WHERE n <> l_orderkey % 8")
def declared_counts(spark: SparkSession, d: str) -> DataFrame:
    """Members that are not as many as declared."""
    nested = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("m")).withColumn("declared", F.col("l_orderkey") % 8)
    return rules.declared_count(nested, "m", "declared").select("l_orderkey", F.size("m").cast("long").alias("members"))


@query("SELECT doc_id FROM documents WHERE doc_id % 13 = 0")
def stored_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Stored digests that are not their content's."""
    digest = F.sha2(F.col("text").cast("binary"), 256)
    rows = table(spark, d, "documents").withColumn("stored", F.when(F.col("doc_id") % 13 == 0, "0").otherwise(digest))
    return rules.stored_hash(rows, F.col("text"), "stored").select("doc_id")


@query("SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_suppkey + l_partkey <> l_orderkey")
def usage_closure(spark: SparkSession, d: str) -> DataFrame:
    """Parts that do not add up to their total."""
    return coverage.usage_closure(table(spark, d, "lineitem"), "l_suppkey", "l_partkey", "l_orderkey").select("l_orderkey", "l_partkey", "l_linenumber")


@query("""
SELECT user_id, chains, ready FROM (SELECT user_id, count_if(event_type = 'signup')::BIGINT AS chains, count_if(event_type = 'purchase')::BIGINT AS ready FROM events GROUP BY 1) WHERE chains > 12 OR ready < 8""")
def history_closure(spark: SparkSession, d: str) -> DataFrame:
    """Groups whose counts are outside what is allowed."""
    e = F.col("event_type")
    counts = table(spark, d, "events").groupBy("user_id").agg(F.count_if(e == "signup").alias("chains"), F.count_if(e == "purchase").alias("ready"))
    return counts.where("chains > 12 or ready < 8")


@query("SELECT conv_id FROM (SELECT conv_id, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS t, count(*) AS n FROM conversations GROUP BY 1) WHERE t <> array_to_string(range(n), ',') OR n % 5 = 0")
def ordered_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Ordered members against a stored array; every fifth length is stored wrong."""
    nested = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    n = F.size("turns")
    stored = F.when(n % 5 == 0, F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long")))
    return nested.where(F.col("turns") != stored).select("conv_id")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'null_required' ELSE 'out_of_range' END AS code FROM orders WHERE (o_orderstatus = 'P' AND o_orderkey % 2 = 0) OR (o_orderstatus = 'F' AND o_orderkey % 9 = 0)")
def metric_fractions(spark: SparkSession, d: str) -> DataFrame:
    """Fractions that a state forbids or that are outside 0 to 1: the range rules of I14."""
    rows = table(spark, d, "orders").withColumn("num", F.when((F.col("o_orderstatus") != "P") | (F.col("o_orderkey") % 2 == 0), F.when(F.col("o_orderkey") % 9 == 0, 2).otherwise(1)))
    code = F.when((F.col("o_orderstatus") == "P") & F.col("num").isNotNull(), "null_required").when((F.col("o_orderstatus") == "F") & ~F.col("num").between(0, 1), "out_of_range")
    return rows.withColumn("code", code).where("code is not null").select("o_orderkey", "code")


@query("SELECT doc_id FROM documents WHERE doc_id % 17 = 0 OR contains(text, 'token = ') OR length(text) > 20000")
def export_scan(spark: SparkSession, d: str) -> DataFrame:
    """Exported texts with hidden characters, secrets or more than their size; every seventeenth gets a mark."""
    rows = table(spark, d, "documents").withColumn("text", F.when(F.col("doc_id") % 17 == 0, F.concat(F.col("text"), F.lit("‮"))).otherwise(F.col("text")))
    bad = rules.bidi_or_control(rows, "text").select("doc_id").union(rules.forbidden(rows, "text", ["token = "]).select("doc_id")).union(rows.where(F.length("text") > 20000).select("doc_id"))
    return bad.distinct()


@query("SELECT 'x' AS lang, 0 AS surplus WHERE false")
def recomputed_reduction(spark: SparkSession, d: str) -> DataFrame:
    """A reduction against itself computed another way; no row is agreement."""
    docs = table(spark, d, "documents")
    direct = docs.groupBy("lang").agg(F.count("*").alias("n"))
    by_source = docs.groupBy("lang", "source").agg(F.count("*").alias("m")).groupBy("lang").agg(F.sum("m").alias("n"))
    return rules.recomputed(direct, by_source).select("lang", F.col("surplus").cast("int").alias("surplus"))
