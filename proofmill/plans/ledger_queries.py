"""Ledgers, retries, model calls, selections and report decisions over the test tables.

Faults are those that the tables have by their own values: orders without lines, long texts, small or large amounts.
The SQL computes each rule again from the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofmill.functions import exact
from proofmill.operators import accuracy, joining, ledger, selecting
from proofmill.plans.registry import query, table

# --- pairs and decisions: three graders of the labelled documents --------------------------------------------------

_ARMS = """
d AS (SELECT doc_id, lang, n_chars, quality, toxic FROM labels JOIN documents USING (doc_id)),
arms AS (SELECT 'a' AS arm, lang, doc_id, quality = 1 AS ok FROM d
  UNION ALL SELECT 'b', lang, doc_id, CASE WHEN n_chars >= 100 THEN toxic = 0 END FROM d WHERE n_chars <= 20000
  UNION ALL SELECT 'c', lang, doc_id, n_chars BETWEEN 400 AND 5000 FROM d)"""


def _pair_sql(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS left_arm, '{b}' AS right_arm, coalesce(l.lang, r.lang) AS lang, bool_and(l.doc_id IS NOT NULL AND r.doc_id IS NOT NULL) AS same_cases,
  count_if(l.ok AND r.ok)::BIGINT AS "both", count_if(l.ok AND NOT r.ok)::BIGINT AS left_only, count_if(NOT l.ok AND r.ok)::BIGINT AS right_only, count_if(NOT l.ok AND NOT r.ok)::BIGINT AS neither, count_if(l.ok IS NULL OR r.ok IS NULL)::BIGINT AS unjudged
  FROM (SELECT * FROM arms WHERE arm = '{a}') l FULL JOIN (SELECT * FROM arms WHERE arm = '{b}') r ON l.doc_id = r.doc_id GROUP BY 3"""


_COUNTS = f"{_ARMS}, c AS ({' UNION ALL '.join(_pair_sql(a, b) for a, b in (('a', 'b'), ('a', 'c'), ('b', 'c')))}), n AS (SELECT *, (\"both\" + left_only + right_only + neither)::BIGINT AS judged, left_only + right_only AS split FROM c)"
_REASON = "CASE WHEN NOT same_cases THEN 'case_sets_differ' WHEN unjudged > 0 THEN 'unjudged_cases' WHEN judged = 0 THEN 'no_cases' END"
_P = """CASE WHEN split = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(left_only, right_only) + 1),
  lambda k: exp(lgamma(split + 1) - lgamma(k + 1) - lgamma(split - k + 1) - split * ln(2))))) END"""


def _arms(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    n = F.col("n_chars")
    return {
        "a": rows.select("lang", "doc_id", (F.col("quality") == 1).alias("ok")),
        "b": rows.where(n <= 20000).select("lang", "doc_id", F.when(n >= 100, F.col("toxic") == 0).alias("ok")),
        "c": rows.select("lang", "doc_id", n.between(400, 5000).alias("ok")),
    }


def _pair_counts(spark: SparkSession, d: str) -> DataFrame:
    arms, found = _arms(spark, d), []
    langs = table(spark, d, "documents").select("doc_id", "lang")
    for a, b in (("a", "b"), ("a", "c"), ("b", "c")):
        pairs = accuracy.paired(arms[a], arms[b], "doc_id", "ok").join(langs, "doc_id")
        found.append(accuracy.paired_counts(pairs, ["lang"]).select(F.lit(a).alias("left_arm"), F.lit(b).alias("right_arm"), "*"))
    return ledger.all_issues(*found)


@query(f"""
WITH {_COUNTS}
SELECT left_arm, right_arm, lang, {_REASON} AS reason, CASE WHEN {_REASON} IS NULL THEN ((left_only - right_only) // greatest(gcd(abs(left_only - right_only), judged), 1))::BIGINT END AS delta_num,
  CASE WHEN {_REASON} IS NULL THEN (judged // greatest(gcd(abs(left_only - right_only), judged), 1))::BIGINT END AS delta_den, CASE WHEN {_REASON} IS NULL THEN round({_P}, 6) END AS p_value FROM n""")
def pair_availability(spark: SparkSession, d: str) -> DataFrame:
    """Delta and exact probability of each pair of arms, or why there is none: case sets that differ, cases
    that are not judged."""
    rows = accuracy.pair_statistics(_pair_counts(spark, d))
    whole = F.col("reason").isNull()
    return rows.select("left_arm", "right_arm", "lang", "reason", "delta_num", "delta_den", F.when(whole, F.round(exact.mcnemar_value(F.col("left_only"), F.col("right_only")), 6)).alias("p_value"))


_DECIDED = f"""{_COUNTS}, e AS (SELECT *, {_REASON} IS NULL AS whole, CASE WHEN {_REASON} IS NULL THEN (left_only - right_only)::DOUBLE / judged END AS delta, CASE WHEN {_REASON} IS NULL THEN {_P} END AS p FROM n),
f AS (SELECT *, whole IS TRUE AS ok1, coalesce(abs(delta) >= 0.02, false) AS ok2, coalesce(p <= 0.05, false) AS ok3 FROM e),
g AS (SELECT *, concat_ws(',', CASE WHEN NOT ok1 THEN 'complete_equal_coverage' END, CASE WHEN NOT ok2 THEN 'minimum_accuracy_delta' END, CASE WHEN NOT ok3 THEN 'maximum_exact_mcnemar_p_value' END) AS failed_predicates,
  CASE WHEN ok1 AND ok2 AND ok3 AND delta > 0 THEN left_arm WHEN ok1 AND ok2 AND ok3 AND delta < 0 THEN right_arm END AS leader FROM f)"""


def _decided(spark: SparkSession, d: str) -> DataFrame:
    rows = accuracy.pair_statistics(_pair_counts(spark, d)).withColumn("complete", F.col("reason").isNull())
    rows = rows.withColumn("delta", F.col("delta_num").cast("double") / F.col("delta_den")).withColumn("p", F.when(F.col("complete"), exact.mcnemar_value(F.col("left_only"), F.col("right_only"))))
    decided = accuracy.pair_decision(rows, 0.02, 0.05, "delta", "p", "complete")
    return decided.withColumn("leader", F.when(F.col("leader") == "left", F.col("left_arm")).when(F.col("leader") == "right", F.col("right_arm")))


@query(f"WITH {_DECIDED} SELECT left_arm, right_arm, lang, failed_predicates, leader FROM g")
def exact_pair_decision(spark: SparkSession, d: str) -> DataFrame:
    """Whom a pair favours, by coverage, difference and the exact probability."""
    return _decided(spark, d).select("left_arm", "right_arm", "lang", "failed_predicates", "leader")


@query(f"""
WITH {_DECIDED}, s AS (SELECT lang, arm, count(*) AS cases, count(ok) AS judged, count_if(ok)::BIGINT AS correct FROM arms GROUP BY ALL),
w AS (SELECT lang, max(cases) AS most FROM s GROUP BY lang), t AS (SELECT s.*, s.cases = most AND judged = most AS full_coverage FROM s JOIN w USING (lang)),
h AS (SELECT x.lang, x.arm, bool_and(y.arm IS NULL OR x.correct * y.judged > y.correct * x.judged) AS top, count(y.arm) AS others FROM t x LEFT JOIN t y ON x.lang = y.lang AND x.arm <> y.arm GROUP BY ALL),
v AS (SELECT lang, leader, count(*) AS won FROM g WHERE leader IS NOT NULL GROUP BY ALL),
r AS (SELECT h.lang, max(CASE WHEN top THEN h.arm END) AS best, bool_or(top AND coalesce(won, 0) = others) AS clears FROM h LEFT JOIN v ON h.lang = v.lang AND h.arm = v.leader GROUP BY 1),
q AS (SELECT lang, bool_and(full_coverage) AS full_coverage FROM t GROUP BY 1),
z AS (SELECT r.lang, best, CASE WHEN NOT full_coverage THEN 'complete_equal_coverage' WHEN best IS NULL THEN 'unique_highest_accuracy' WHEN NOT clears THEN 'all_pairwise_thresholds' ELSE '' END AS failed_predicate FROM r JOIN q USING (lang))
SELECT lang, CASE WHEN failed_predicate = '' THEN best END AS leader, failed_predicate FROM z""")
def report_leader(spark: SparkSession, d: str) -> DataFrame:
    """The arm of the one highest accuracy, if it also leads each of its pairs."""
    rows = ledger.all_issues(*[rows.select(F.lit(arm).alias("arm"), "lang", "ok") for arm, rows in _arms(spark, d).items()])
    cells = rows.groupBy("lang", "arm").agg(F.count("*").alias("cases"), F.count("ok").alias("judged"), F.count_if("ok").alias("correct"))
    cells = cells.withColumn("_most", F.max("cases").over(Window.partitionBy("lang"))).withColumn("complete", (F.col("cases") == F.col("_most")) & (F.col("judged") == F.col("_most")))
    return accuracy.report_leader(cells, _decided(spark, d), ["lang"], "arm", "correct", "judged", "complete")


@query("""
WITH c AS (SELECT source, CASE WHEN count(DISTINCT lang) = 1 THEN min(lang) END AS revision, count(*) AS cases, count(quality) AS judged, count_if(n_chars > 0)::BIGINT AS completed, count_if(toxic = 0)::BIGINT AS denominator
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)
SELECT a.source AS left_source, b.source AS right_source, concat_ws(',', CASE WHEN a.revision = b.revision THEN NULL ELSE 'revision' END, CASE WHEN a.judged = a.cases AND b.judged = b.cases THEN NULL ELSE 'judged_coverage' END,
  CASE WHEN a.completed = a.cases AND b.completed = b.cases THEN NULL ELSE 'terminal_coverage' END, CASE WHEN a.denominator > 0 AND b.denominator > 0 THEN NULL ELSE 'denominator' END) AS limitations FROM c a JOIN c b ON a.source < b.source""")
def pair_comparability(spark: SparkSession, d: str) -> DataFrame:
    """What stands against comparing two sources: revision, metric, judged and terminal coverage, denominator."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    cells = rows.groupBy("source").agg(
        F.when(F.count_distinct("lang") == 1, F.min("lang")).alias("revision"), F.lit("accuracy").alias("metric"), F.count("*").alias("cases"), F.count("quality").alias("judged"),
        F.count_if(F.col("n_chars") > 0).alias("completed"), F.count_if(F.col("toxic") == 0).alias("denominator"),
    )
    found = accuracy.pair_comparability(accuracy.arm_pairs(cells, "source"))
    return found.select("left_source", "right_source", F.array_join("limitations", ",").alias("limitations"))


@query("""
WITH s AS (SELECT event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cost FROM events GROUP BY 1), o AS (SELECT *, lag(n) OVER (ORDER BY event_type) AS n0, lag(cost) OVER (ORDER BY event_type) AS c0 FROM s)
SELECT event_type, coalesce(c0 > 0 AND n0 > 0 AND n > 0 AND cost >= 0 AND cost::DOUBLE * n0 <= 1.01 * c0 * n, false) AS within FROM o""")
def performance_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether cost grows by at most 1.01 times what the size grows, from one row to the next."""
    sums = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cost"))
    w = Window.orderBy("event_type")  # one row per type
    both = sums.withColumn("n0", F.lag("n").over(w)).withColumn("c0", F.lag("cost").over(w))
    return both.select("event_type", accuracy.ratio_gate(F.col("c0"), F.col("cost"), F.col("n0"), F.col("n"), 1.01).alias("within"))


# --- model calls and usage ------------------------------------------------------------------------------------------

_BODY = """CASE WHEN length(text) > 900 THEN 'truncated' WHEN contains(text, '?') THEN 'refused' WHEN contains(text, 'shed') THEN 'tool_calls' WHEN length(text) < 30 THEN 'usage' END"""


def _completion_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Each message as the completion that a model might have sent it in, with faults that follow from the text."""
    t = F.col("text")
    message = F.struct(
        F.concat(F.lit(" \n"), t).alias("content"), F.when(F.contains(t, F.lit("?")), "no").alias("refusal"), F.when(F.contains(t, F.lit("shed")), F.array(F.lit("call"))).alias("tool_calls")
    )
    choice = F.struct(F.when(F.length(t) > 900, "length").otherwise("stop").alias("finish_reason"), message.alias("message"))
    usage = F.struct(F.length(t).alias("prompt_tokens"), F.when(F.length(t) < 30, F.lit("many")).otherwise(F.length(t).cast("string")).try_cast("int").alias("completion_tokens"), (2 * F.length(t)).alias("total_tokens"))
    return table(spark, d, "conversations").withColumn("body", F.to_json(F.struct(F.array(choice).alias("choices"), usage.alias("usage"))))


@query(f"""
WITH p AS (SELECT *, {_BODY} AS problem FROM conversations)
SELECT conv_id, turn, problem, CASE WHEN problem IS NULL THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS content, CASE WHEN problem IS NULL THEN 2 * length(text) END::BIGINT AS total_tokens FROM p""")
def completion_parse(spark: SparkSession, d: str) -> DataFrame:
    """Content and usage of completions that are whole; else the first thing wrong with them."""
    return _completion_bodies(spark, d).select("conv_id", "turn", F.inline(F.array(ledger.completion(F.col("body"))))).drop("prompt_tokens", "completion_tokens")


@query(f"""
WITH m AS (SELECT conv_id, turn, role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS content, {_BODY} AS problem, sha256(coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '')) AS request FROM conversations)
SELECT conv_id, turn FROM m r WHERE role = 'assistant' AND NOT EXISTS (SELECT 1 FROM m c WHERE c.problem IS NULL AND c.role = r.role AND c.content = r.content AND c.request = r.request)""")
def unproved_results(spark: SparkSession, d: str) -> DataFrame:
    """Saved answers without a whole model call of that stage, content and request."""
    before = F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    rows = _completion_bodies(spark, d).withColumn("request", F.sha2(before.cast("binary"), 256)).withColumn("c", ledger.completion(F.col("body")))
    results = rows.where("role = 'assistant'").select("conv_id", "turn", F.col("role").alias("stage"), F.regexp_replace("text", r"^\s+|\s+$", "").alias("content"), "request")
    calls = rows.where("c.problem is null").select(F.col("role").alias("stage"), "c.content", "request")
    return ledger.unproved_results(results, calls, ["stage", "content", "request"]).select("conv_id", "turn")


@query("""
WITH u AS (SELECT *, l_quantity::BIGINT AS n, CASE WHEN l_returnflag = 'N' THEN 2 ELSE 3 END AS v FROM lineitem WHERE l_linestatus = 'F'), k AS (SELECT l_orderkey, max(v) AS v, sum(n)::BIGINT AS n, sum(l_suppkey)::BIGINT AS c FROM u GROUP BY 1)
SELECT o_orderkey, v AS source_version, n AS input_tokens, CASE WHEN v = 3 THEN c END AS cached_input_tokens, CASE WHEN v IS NULL THEN 'unavailable' ELSE 'measured_partial' END AS proof_status,
  CASE WHEN v IS NULL THEN 'input_tokens,visible_output_tokens,supplier_reported_total_tokens,cached_input_tokens,reasoning_tokens' WHEN v = 2 THEN 'cached_input_tokens,reasoning_tokens' ELSE 'reasoning_tokens' END AS unavailable,
  CASE WHEN v IS NULL THEN 'supplier_token_usage_unavailable' END AS reason FROM orders LEFT JOIN k ON o_orderkey = l_orderkey""")
def usage_upgrade(spark: SparkSession, d: str) -> DataFrame:
    """Usage of versions 2 and 3 as the newest version, all dimensions unavailable without a record."""
    u = table(spark, d, "lineitem").where("l_linestatus = 'F'").withColumn("n", F.col("l_quantity").cast("long")).withColumn("v", F.when(F.col("l_returnflag") == "N", 2).otherwise(3))
    k = u.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max("v").alias("v"), F.sum("n").alias("input_tokens"), F.sum("n").alias("visible_output_tokens"), (2 * F.sum("n")).alias("supplier_reported_total_tokens"), F.sum("l_suppkey").alias("cached_input_tokens"), F.lit(None).cast("long").alias("reasoning_tokens")
    )
    up = ledger.upgrade_usage(k.where("v = 2"), k.where("v = 3"), table(spark, d, "orders"), "o_orderkey")
    return up.select("o_orderkey", "source_version", "input_tokens", "cached_input_tokens", "proof_status", F.array_join("unavailable", ",").alias("unavailable"), "reason")


@query("""
WITH l AS (SELECT o_orderkey, o_custkey::BIGINT + 1 AS n, o_orderkey % (o_custkey + 1) AS hit, o_orderstatus AS flag, substr(o_orderpriority, 1, 1) AS kind, o_totalprice > 100000 AS thought FROM orders),
p AS (SELECT *, CASE WHEN n < 20 THEN 'base' WHEN flag = 'F' AND kind = '1' THEN 'alias_pair' WHEN flag = 'F' AND kind = '2' THEN 'alias_sum' WHEN flag = 'F' AND kind = '3' AND hit <> 0 THEN 'alias_detail' END AS problem FROM l)
SELECT o_orderkey, problem, CASE WHEN problem IS NULL THEN n END AS input_tokens, CASE WHEN problem IS NULL THEN CASE flag WHEN 'F' THEN hit WHEN 'P' THEN 0 END END AS cached_input_tokens,
  CASE WHEN problem IS NULL THEN CASE WHEN flag <> 'O' AND thought AND kind <> '5' THEN 'measured_complete' ELSE 'measured_partial' END END AS proof_status,
  concat_ws(',', CASE WHEN kind = '5' THEN 'unknown_field:extra' END, CASE WHEN flag = 'O' THEN 'unavailable:cached_input_tokens' END, CASE WHEN NOT thought THEN 'unavailable:reasoning_tokens' END) AS limitations FROM p""")
def usage_details(spark: SparkSession, d: str) -> DataFrame:
    """Usage by nested detail, else by a pair of aliases that have to agree with each other and with the detail."""
    n, flag, kind = F.col("o_custkey") + 1, F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
    hit, aliased = F.col("o_orderkey") % n, flag == "F"
    nested = F.when((flag == "P") | (aliased & (kind == "3")), F.struct(F.lit(0).alias("cached_tokens")))
    body = F.to_json(F.struct(
        F.when(n >= 20, n).alias("prompt_tokens"), n.alias("completion_tokens"), (2 * n).alias("total_tokens"), nested.alias("prompt_tokens_details"), F.when(F.col("o_totalprice") > 100000, F.struct(F.lit(0).alias("reasoning_tokens"))).alias("completion_tokens_details"),
        F.when(aliased, hit).alias("prompt_cache_hit_tokens"), F.when(aliased & (kind != "1"), n - hit + F.when(kind == "2", 1).otherwise(0)).alias("prompt_cache_miss_tokens"), F.when(kind == "5", F.lit("x")).alias("extra"),
    ))
    # inline takes the struct apart once; fields taken one by one would each parse the text again
    rows = table(spark, d, "orders").select("o_orderkey", F.inline(F.array(ledger.usage_details(body))))
    return rows.drop("visible_output_tokens", "supplier_reported_total_tokens", "reasoning_tokens")


@query("""
SELECT event_id, CASE WHEN event_type = 'signup' THEN 'fields' WHEN event_type = 'error' THEN 'final' WHEN event_type = 'view' AND value > 20 THEN 'reranker' WHEN event_type = 'click' AND value > 50 THEN 'score' END AS problem,
  CASE WHEN event_type = 'purchase' OR (event_type = 'view' AND NOT value > 20) OR (event_type = 'click' AND NOT value > 50) THEN event_id::VARCHAR END AS score FROM events""")
def recall_scores(spark: SparkSession, d: str) -> DataFrame:
    """Recall scores as the text of their number; a reranker score, other fields and texts for numbers are problems."""
    kind, v = F.col("event_type"), F.col("value")
    scores = F.to_json(F.struct(
        F.when(kind != "error", F.col("event_id")).alias("final"), F.when((kind == "view") & (v > 20), v).alias("reranker"), F.when((kind == "click") & (v > 50), F.lit("high")).alias("semantic"), F.when(kind == "signup", 1).alias("other")
    ))
    return table(spark, d, "events").select("event_id", F.inline(F.array(ledger.recall_score(scores)))).select("event_id", "problem", "score")


# --- ledgers, retries and chains ------------------------------------------------------------------------------------

_LINES = "x AS (SELECT l_orderkey, count(*) AS lines, max(l_tax) AS tax FROM lineitem GROUP BY 1)"


def _order_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.max("l_tax").alias("tax"))


@query(f"""
WITH {_LINES}, j AS (SELECT * FROM orders JOIN x ON o_orderkey = l_orderkey), good AS (SELECT o_orderkey FROM j WHERE lines < 8 AND o_totalprice >= 5000 AND o_totalprice <= 400000)
SELECT 'sources' AS code, l_orderkey::VARCHAR AS ref FROM x WHERE lines >= 8 UNION ALL
SELECT 'unknown_source', l_orderkey::VARCHAR FROM x WHERE lines < 8 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice >= 5000) UNION ALL
SELECT 'binding', o_orderkey::VARCHAR FROM j WHERE lines < 8 AND o_totalprice > 400000 UNION ALL
SELECT 'attempt_cost', o_orderkey::VARCHAR FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM good) UNION ALL
SELECT 'resource_cost', o_orderkey::VARCHAR FROM orders WHERE o_totalprice >= 5000 AND o_orderkey NOT IN (SELECT o_orderkey FROM good)""")
def ledger_closure(spark: SparkSession, d: str) -> DataFrame:
    """Orders as attempts, their lines as usage and cost; no resource for small orders, another owner for large
    ones, a second source where there are many lines."""
    orders, x = table(spark, d, "orders"), _order_lines(spark, d)
    attempts = orders.select(F.col("o_orderkey").alias("attempt_id"), F.col("o_custkey").alias("parent_id"), F.col("o_orderstatus").alias("stage"))
    usage = x.select(F.col("l_orderkey").alias("usage_id"), F.col("l_orderkey").alias("attempt_id"))
    resources = orders.where("o_totalprice >= 5000").select(F.col("o_orderkey").alias("resource_id"), F.col("o_custkey").alias("parent_id"), F.when(F.col("o_totalprice") > 400000, "moved").otherwise(F.col("o_orderstatus")).alias("stage"))
    owner = orders.select(F.col("o_orderkey").alias("_o"), F.col("o_custkey").alias("parent_id"))
    sources = F.when(F.col("lines") >= 8, F.array("l_orderkey", "l_orderkey")).otherwise(F.array("l_orderkey"))
    costs = x.join(owner, F.col("l_orderkey") == F.col("_o"), "left").select(F.col("l_orderkey").alias("cost_id"), "parent_id", sources.alias("usage_ids"), F.array("l_orderkey").alias("resource_ids"))
    return ledger.ownership_issues(attempts, usage, resources, costs)


@query("""
WITH v AS (SELECT l_orderkey, count(*) AS n, min(l_linestatus) AS s FROM lineitem GROUP BY 1)
SELECT CASE WHEN l_orderkey IS NULL THEN 'without_view' WHEN o_orderkey IS NULL THEN 'without_record' WHEN n > 1 THEN 'duplicate_view' ELSE 'owner_differs' END AS code, coalesce(o_orderkey, l_orderkey)::VARCHAR AS ref
FROM orders FULL JOIN v ON o_orderkey = l_orderkey WHERE l_orderkey IS NULL OR o_orderkey IS NULL OR n > 1 OR o_orderstatus IS DISTINCT FROM s""")
def view_closure(spark: SparkSession, d: str) -> DataFrame:
    """Records and their views closed both ways: one view each, of the same owner."""
    records = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("owner"))
    views = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linestatus").alias("owner"))
    return ledger.view_closure(records, views, "id", "owner")


_BACKOFF = [5, 10, 20, 40, 80, 160]
_RETRIES = f"""
e AS (SELECT user_id * 10 + length(event_type) AS attempt_id, event_id AS call_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS ordinal FROM events),
r AS (SELECT *, value >= 3 AS scheduled, CASE WHEN ordinal <= {len(_BACKOFF)} THEN ({_BACKOFF})[ordinal] + (value > 100)::INT END AS backoff FROM e WHERE value >= 0.5)"""


def _retry_events(spark: SparkSession, d: str) -> DataFrame:
    """Events as supplier calls: tiny ones are lost, small ones end the retries, large ones wait a second too long."""
    key = (F.col("user_id") * 10 + F.length("event_type")).alias("attempt_id")
    rows = table(spark, d, "events").select(key, F.col("event_id").alias("call_id"), "value", "event_type", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id")).alias("ordinal"))
    wait = F.when(F.col("ordinal") <= len(_BACKOFF), F.get(F.array(*[F.lit(b) for b in _BACKOFF]), F.col("ordinal") - 1) + (F.col("value") > 100).cast("int"))
    return rows.where("value >= 0.5").select("attempt_id", "call_id", "event_type", "ordinal", (F.col("value") >= 3).alias("scheduled"), wait.alias("backoff"), F.floor(F.col("value") / 50).cast("long").alias("internal"))


@query(f"""
WITH {_RETRIES}, w AS (SELECT *, row_number() OVER (PARTITION BY attempt_id ORDER BY ordinal, call_id) AS place, count(*) OVER (PARTITION BY attempt_id) AS n FROM r)
SELECT 'ordinals' AS code, attempt_id::VARCHAR AS ref FROM w GROUP BY attempt_id HAVING bool_or(ordinal <> place) UNION ALL
SELECT 'backoff', attempt_id::VARCHAR FROM w GROUP BY attempt_id HAVING bool_or(scheduled AND (ordinal > {len(_BACKOFF)} OR value > 100)) UNION ALL
SELECT 'unscheduled', attempt_id::VARCHAR FROM w GROUP BY attempt_id HAVING bool_or(NOT scheduled AND place < n)""")
def retry_schedule(spark: SparkSession, d: str) -> DataFrame:
    """I8: retry events with contiguous ordinals, the scheduled waits, and only the last one unscheduled."""
    return ledger.retry_issues(_retry_events(spark, d).drop("event_type", "internal"), _BACKOFF)


@query(f"""
WITH {_RETRIES}, k AS (SELECT event_type, r.* FROM r JOIN events USING (value) WHERE call_id = event_id)
SELECT event_type, count(*) AS events, count_if(scheduled)::BIGINT AS scheduled, sum(floor(value / 50)::BIGINT)::BIGINT AS internal, sum(floor(value / 50)::BIGINT + scheduled::INT)::BIGINT AS units, sum(floor(value / 50)::BIGINT + scheduled::INT) <= 2000 AS within_cap FROM k GROUP BY 1""")
def retry_totals(spark: SparkSession, d: str) -> DataFrame:
    """A10: scheduled and internal retries per type against the cap."""
    return ledger.retry_totals(_retry_events(spark, d), ["event_type"], 2000)


@query("""
WITH m AS (SELECT conv_id, turn, role, text, conv_id * 1000 + turn AS id, lag(conv_id * 1000 + turn) OVER w AS before, row_number() OVER w AS place, lead(turn) OVER w IS NULL AS last FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
a AS (SELECT *, CASE WHEN length(text) > 1500 THEN NULL ELSE before END AS retry_of, CASE WHEN role = 'assistant' THEN 'succeeded' ELSE 'failed' END AS outcome FROM m)
SELECT 'length' AS code, conv_id::VARCHAR AS ref FROM a GROUP BY conv_id HAVING count(*) > 4 UNION ALL
SELECT 'link', conv_id::VARCHAR FROM a GROUP BY conv_id HAVING bool_or(place > 1 AND retry_of IS NULL) UNION ALL
SELECT 'predecessor', conv_id::VARCHAR FROM a GROUP BY conv_id HAVING bool_or(NOT last AND outcome = 'succeeded') UNION ALL
SELECT 'last', conv_id::VARCHAR FROM a GROUP BY conv_id HAVING bool_or(last AND outcome <> 'succeeded') UNION ALL
SELECT 'prompt', conv_id::VARCHAR FROM a GROUP BY conv_id HAVING bool_or(place = 1 AND (text LIKE ' %' OR text LIKE '% ' OR contains(text, chr(10))))""")
def attempt_chains(spark: SparkSession, d: str) -> DataFrame:
    """Chains of at most 4 attempts, each after failed ones, whose first sends the prompt (here without line breaks)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    ident = F.col("conv_id") * 1000 + F.col("turn")
    rows = table(spark, d, "conversations").withColumn("attempt_id", ident).withColumn("_before", F.lag(ident).over(w))
    sent = F.regexp_replace(F.trim("text"), "\n", " ")
    return ledger.chain_issues(rows.select(
        F.col("conv_id").alias("chain_id"), F.col("turn").alias("ordinal"), "attempt_id", F.when(F.length("text") <= 1500, F.col("_before")).alias("retry_of"), F.when(F.col("role") == "assistant", "succeeded").otherwise("failed").alias("outcome"),
        F.sha2(F.col("text").cast("binary"), 256).alias("prompt_sha256"), F.sha2(sent.cast("binary"), 256).alias("request_sha256"),
    ), 4)


@query("""
WITH l AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 'answer' ELSE 'memory_ingest' END AS stage, CASE WHEN l_linestatus = 'F' THEN 'succeeded' ELSE 'failed' END AS outcome, CASE WHEN l_tax >= 0.04 THEN 'final' ELSE 'none' END AS contribution, o_orderstatus = 'F' AS sealed
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey), x AS (SELECT *, CASE WHEN stage <> 'memory_ingest' THEN 'not_applicable' WHEN outcome = 'succeeded' AND sealed THEN 'final' ELSE 'none' END AS expected FROM l)
SELECT stage, expected, contribution, count(*) AS attempts, count_if(expected <> contribution)::BIGINT AS wrong FROM x GROUP BY ALL""")
def index_contributions(spark: SparkSession, d: str) -> DataFrame:
    """What each attempt has to add to the index, against what its record says."""
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("parent_id"), F.when(F.col("l_returnflag") == "A", "answer").otherwise("memory_ingest").alias("stage"),
        F.when(F.col("l_linestatus") == "F", "succeeded").otherwise("failed").alias("outcome"), F.when(F.col("l_tax") >= 0.04, "final").otherwise("none").alias("contribution"),
    )
    plans = table(spark, d, "orders").select(F.col("o_orderkey").alias("plan_id"), F.when(F.col("o_orderstatus") == "F", "sealed").otherwise("open").alias("state"))
    found = ledger.index_contributions(rows, plans)
    return found.groupBy("stage", "expected", "contribution").agg(F.count("*").alias("attempts"), F.count_if(F.col("expected") != F.col("contribution")).alias("wrong"))


# --- selections, counters and constants -----------------------------------------------------------------------------


@query("""
SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY k, doc_id) AS place FROM (SELECT lang, doc_id, sha256('evidence' || chr(0) || doc_id) AS k FROM documents) QUALIFY place <= 6""")
def frozen_selection(spark: SparkSession, d: str) -> DataFrame:
    """Six of each stratum by hash of prefix, zero byte and id; too small a stratum is an error."""
    return selecting.stratified_hash_top(table(spark, d, "documents"), "lang", "doc_id", "evidence", 6).select("lang", "doc_id", "place")


@query("""
WITH m AS (SELECT doc_id, n_chars * 1000000000 + doc_id AS ordinal FROM documents), r AS (SELECT doc_id, quality::BIGINT * 1000000000 + doc_id AS place FROM labels), q AS (SELECT r.*, ordinal FROM r LEFT JOIN m USING (doc_id)),
b AS (SELECT *, max(ordinal) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM q)
SELECT 'out_of_order' AS code, doc_id::VARCHAR AS ref FROM b WHERE ordinal < before UNION ALL SELECT 'unknown_request', doc_id::VARCHAR FROM b WHERE ordinal IS NULL""")
def manifest_selection(spark: SparkSession, d: str) -> DataFrame:
    """A selection that has to be known, unique and in the manifest's order; what breaks that."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    m = docs.select("doc_id", (F.col("n_chars") * 1_000_000_000 + F.col("doc_id")).alias("ordinal"))
    asked = labels.select("doc_id", (F.col("quality").cast("long") * 1_000_000_000 + F.col("doc_id")).alias("place"))
    return selecting.manifest_selection(m, m, asked, "doc_id", "ordinal")[1]


@query("""
WITH m AS (SELECT doc_id, doc_id - n_chars * 1000000000 AS ordinal, sha256(CASE WHEN n_chars > 3000 THEN text || ' ' ELSE text END) AS sha FROM documents), l AS (SELECT DISTINCT doc_id FROM labels)
SELECT ordinal, m.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN sha256(text) <> sha THEN 'changed' END AS problem, CASE WHEN l.doc_id IS NOT NULL AND sha256(text) = sha THEN length(text) END AS chars FROM m LEFT JOIN l USING (doc_id) JOIN documents USING (doc_id)""")
def question_texts(spark: SparkSession, d: str) -> DataFrame:
    """The manifest's questions in its order with their text, where it hashes to the manifest's digest."""
    docs = table(spark, d, "documents")
    sha = F.sha2(F.when(F.col("n_chars") > 3000, F.concat("text", F.lit(" "))).otherwise(F.col("text")).cast("binary"), 256)
    m = docs.select("doc_id", (F.col("doc_id") - F.col("n_chars") * 1_000_000_000).alias("ordinal"), sha.alias("sha"))
    rows = docs.select("doc_id", "text").join(table(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    found = ledger.question_texts(m, rows, "doc_id", "ordinal", "text", "sha")
    return found.select("ordinal", "doc_id", "problem", F.length("text").cast("long").alias("chars"))


_STATES = "CASE o_orderpriority WHEN '1-URGENT' THEN 'error' WHEN '2-HIGH' THEN 'unsupported' WHEN '3-MEDIUM' THEN 'cancelled' WHEN '4-NOT SPECIFIED' THEN 'pending' ELSE 'completed' END"


@query(f"""
WITH c AS (SELECT {_STATES} AS state, CASE o_orderstatus WHEN 'F' THEN 'judged' WHEN 'O' THEN 'unjudged' ELSE 'deterministic' END AS disposition, o_totalprice > 100000 AS parsed FROM orders)
SELECT count(*) AS intended_cases, count_if(state <> 'pending')::BIGINT AS terminal_cases, count_if(state = 'completed')::BIGINT AS completed_cases, count_if(state = 'error')::BIGINT AS errored_cases, count_if(state = 'unsupported')::BIGINT AS unsupported_cases,
  count_if(state = 'cancelled')::BIGINT AS cancelled_cases, count_if(state = 'budget_exceeded')::BIGINT AS budget_exceeded_cases, count_if(parsed)::BIGINT AS parsed_cases, count_if(disposition <> 'unjudged')::BIGINT AS evaluated_cases, count_if(disposition = 'judged')::BIGINT AS judged_cases,
  count_if(disposition = 'unjudged')::BIGINT AS unjudged_cases, count_if(state = 'completed' AND disposition <> 'unjudged')::BIGINT AS metric_eligible_cases, (SELECT count(*) FROM customer) AS intended_plans, (SELECT count_if(c_acctbal > 0) FROM customer)::BIGINT AS ready_plans,
  (SELECT count(DISTINCT c_nationkey) FROM customer) AS intended_contexts FROM c""")
def run_counters(spark: SparkSession, d: str) -> DataFrame:
    """All completion counters of a run."""
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    state = F.when(p == "1-URGENT", "error").when(p == "2-HIGH", "unsupported").when(p == "3-MEDIUM", "cancelled").when(p == "4-NOT SPECIFIED", "pending").otherwise("completed")
    cases = table(spark, d, "orders").select(state.alias("state"), F.when(s == "F", "judged").when(s == "O", "unjudged").otherwise("deterministic").alias("disposition"), (F.col("o_totalprice") > 100000).alias("parsed"))
    customer = table(spark, d, "customer")
    return ledger.run_counters(customer.select(F.col("c_nationkey").alias("context_id")), customer.select(F.when(F.col("c_acctbal") > 0, "sealed").otherwise("open").alias("state")), cases)


@query("""
WITH e AS (SELECT event_type, CASE WHEN value < 5 THEN 'failed' WHEN value > 100 THEN 'unknown_outcome' ELSE 'succeeded' END AS outcome, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS retry_of FROM events)
SELECT event_type, count(*) AS attempts, count_if(outcome = 'succeeded')::BIGINT AS succeeded, count_if(outcome = 'failed')::BIGINT AS failed, count_if(outcome = 'unknown_outcome')::BIGINT AS unknown_outcome, count(retry_of) AS retries FROM e GROUP BY 1""")
def attempt_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Attempts by outcome, and how many retry another."""
    v = F.col("value")
    retry = F.lag("event_id").over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    rows = table(spark, d, "events").select("event_type", F.when(v < 5, "failed").when(v > 100, "unknown_outcome").otherwise("succeeded").alias("outcome"), retry.alias("retry_of"))
    return ledger.attempt_outcomes(rows, ["event_type"])


@query("""
SELECT coalesce(a.o_orderkey, b.l_orderkey) AS o_orderkey, CASE WHEN b.l_orderkey IS NULL THEN 'missing' WHEN a.o_orderkey IS NULL THEN 'extra' ELSE concat_ws(',', CASE WHEN a.o_orderstatus IS DISTINCT FROM b.s THEN 'status' END, CASE WHEN round(a.o_totalprice) IS DISTINCT FROM b.t THEN 'total' END) END AS differing
FROM orders a FULL JOIN (SELECT l_orderkey, min(l_linestatus) AS s, round(sum(l_extendedprice)) AS t FROM lineitem GROUP BY 1) b ON a.o_orderkey = b.l_orderkey
WHERE b.l_orderkey IS NULL OR a.o_orderkey IS NULL OR a.o_orderstatus IS DISTINCT FROM b.s OR round(a.o_totalprice) IS DISTINCT FROM b.t""")
def two_way_mismatches(spark: SparkSession, d: str) -> DataFrame:
    """Records of two sides by key, keys that one side lacks and fields that differ."""
    a = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.round("o_totalprice").alias("total"))
    b = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_linestatus").alias("status"), F.round(F.sum("l_extendedprice")).alias("total"))
    return joining.field_mismatches(a, b, "o_orderkey", ["status", "total"]).select("o_orderkey", F.array_join("differing", ",").alias("differing"))


@query("""
SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND NOT (o_orderpriority = '5-LOW' AND o_totalprice < 150000 AND o_custkey > 20)""")
def carried_results(spark: SparkSession, d: str) -> DataFrame:
    """carried results that may not be: another dataset, a score, a correct answer or fields beyond the allowed."""
    fields = F.array_compact(F.array(F.lit("question_id"), F.lit("score"), F.when(F.col("o_custkey") <= 20, "context")))
    rows = table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", "carried").otherwise("current").alias("evaluation_status"), F.col("o_orderpriority").alias("dataset"),
        F.when(F.col("o_totalprice") < 150000, 0).otherwise(1).alias("score"), (F.col("o_totalprice") >= 150000).alias("correct"), fields.alias("fields"),
    )
    return ledger.carried_issues(rows, "carried", "5-LOW", ["question_id", "score"]).select("o_orderkey")


@query("""
WITH s AS (SELECT l_orderkey, sum(l_quantity::BIGINT)::BIGINT AS parts, min(l_linestatus) AS origin, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1)
SELECT 'origin' AS code, l_orderkey::VARCHAR AS ref FROM s WHERE origin <> 'F' UNION ALL SELECT 'declared', l_orderkey::VARCHAR FROM s WHERE returned > 2""")
def external_provenance(spark: SparkSession, d: str) -> DataFrame:
    """External evidence whose constants or totals are not what they have to be."""
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity").cast("long")).alias("parts"), F.min("l_linestatus").alias("origin"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.sum(F.col("l_quantity").cast("long")).alias("total"))
    rows = s.select("l_orderkey", "origin", "parts", (F.col("total") + F.when(F.col("returned") > 2, 1).otherwise(0)).alias("declared"))
    return ledger.constant_drift(rows, "l_orderkey", {"origin": "F"}, {"declared": "parts"})
