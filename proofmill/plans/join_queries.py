"""Joins, selections, sets and facets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofmill.operators import joining, selecting
from proofmill.plans.registry import query, table


@query("""
SELECT lang, doc_id, selection_rank, place FROM (SELECT lang, doc_id, sha256('evidence:' || doc_id) AS selection_rank, row_number() OVER (PARTITION BY lang ORDER BY sha256('evidence:' || doc_id), doc_id) AS place FROM documents) WHERE place <= 5""")
def hash_stratified_topk(spark: SparkSession, d: str) -> DataFrame:
    """The first five of each stratum by hash."""
    return selecting.stratified_hash_top(table(spark, d, "documents"), "lang", "doc_id", "evidence:", 5, separator="").select("lang", "doc_id", "selection_rank", "place")


@query("SELECT user_id, event_id, place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place FROM events) WHERE place <= 3")
def top_candidates(spark: SparkSession, d: str) -> DataFrame:
    """T4 T5: the first candidates per question in a stable order."""
    return selecting.top_candidates(table(spark, d, "events"), ["user_id"], [F.desc("value"), F.asc("event_id")], 3).select("user_id", "event_id", "place")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def remaining_ids(spark: SparkSession, d: str) -> DataFrame:
    """Manifest minus saved."""
    return selecting.remaining(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select("doc_id", "lang")


@query("""
SELECT (SELECT count(*) FROM (SELECT DISTINCT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS only_left, (SELECT count(*) FROM (SELECT DISTINCT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) AS only_right,
       (SELECT count(*) FROM (SELECT DISTINCT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) AS in_both, false AS equal""")
def set_closure(spark: SparkSession, d: str) -> DataFrame:
    """Equality and differences of two key sets."""
    return selecting.set_closure(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("""
SELECT o_orderpriority, o_orderstatus, sum(n)::BIGINT AS surplus FROM (SELECT o_orderpriority, o_orderstatus, 1 AS n FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderpriority, o_orderstatus, -1 FROM orders WHERE o_orderkey % 2 = 1) GROUP BY ALL HAVING sum(n) <> 0""")
def multiset_difference(spark: SparkSession, d: str) -> DataFrame:
    """Multisets that differ, by surplus."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    even, odd = rows.where("o_orderkey % 2 = 0").drop("o_orderkey"), rows.where("o_orderkey % 2 = 1").drop("o_orderkey")
    return selecting.multiset_difference(even, odd)


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view') AND user_id IN (1, 2, 3, 5, 8, 13) AND contains(lower(props), '\"k\": 1')")
def facet_filter(spark: SparkSession, d: str) -> DataFrame:
    """Any value of a facet, all facets, and text."""
    return selecting.facet_filter(table(spark, d, "events"), {"event_type": ["click", "view"], "user_id": [1, 2, 3, 5, 8, 13]}, F.col("props"), '"K": 1').select("event_id", "event_type")


@query("SELECT event_id, place FROM (SELECT event_id, row_number() OVER (ORDER BY CASE WHEN event_type <> 'error' THEN value END ASC NULLS LAST, event_id) AS place FROM events) WHERE place <= 50")
def facet_sort(spark: SparkSession, d: str) -> DataFrame:
    """A page of a sort with nulls last and stable ties: a top-k per partition, not a global sort."""
    rows = table(spark, d, "events").withColumn("v", F.when(F.col("event_type") != "error", F.col("value")))
    page = rows.orderBy(F.col("v").asc_nulls_last(), "event_id").limit(50)
    return page.withColumn("place", F.row_number().over(Window.orderBy(F.col("v").asc_nulls_last(), "event_id"))).select("event_id", "place")


@query("""
SELECT facet, value, count(*) AS "count" FROM (SELECT 'lang' AS facet, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents) GROUP BY ALL""")
def facet_values(spark: SparkSession, d: str) -> DataFrame:
    """The inventory of facet values."""
    return selecting.facet_values(table(spark, d, "documents"), ["lang", "source"])


@query("SELECT o_custkey, count_if(o_orderstatus = 'P')::BIGINT AS hits, count(*) AS members FROM orders GROUP BY 1 HAVING count_if(o_orderstatus = 'P') > 0")
def any_fail_filter(spark: SparkSession, d: str) -> DataFrame:
    """groups of which at least one member fails."""
    return selecting.any_member(table(spark, d, "orders"), ["o_custkey"], F.col("o_orderstatus") == "P")


@query("""
SELECT CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' THEN 'pending' WHEN NOT (user_id % 3 = 0) THEN 'unjudged' WHEN value > 10 THEN 'correct' ELSE 'incorrect' END AS state, count(*) AS n FROM events GROUP BY 1""")
def display_states(spark: SparkSession, d: str) -> DataFrame:
    """What each case shows."""
    state = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "pending").otherwise("completed")
    shown = selecting.display_state(state, F.col("user_id") % 3 == 0, F.col("value") > 10)
    return table(spark, d, "events").groupBy(shown.alias("state")).agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def mode_pick(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent value."""
    return selecting.mode_pick(table(spark, d, "customer"), "c_mktsegment")


@query("SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys that are not unique."""
    return joining.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def strict_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A lookup in which an unknown key is an error."""
    customers = table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return joining.strict_lookup(table(spark, d, "orders"), customers, "o_custkey", ["c_mktsegment"]).select("o_orderkey", "c_mktsegment")


@query("""
WITH a AS (SELECT l_orderkey, list(DISTINCT l_suppkey) AS ids FROM lineitem GROUP BY 1), x AS (SELECT l_orderkey, unnest(ids) AS id FROM a) SELECT l_orderkey, count(*) AS suppliers, sum(s_nationkey)::BIGINT AS nations FROM x JOIN supplier ON id = s_suppkey GROUP BY 1""")
def array_explode_join(spark: SparkSession, d: str) -> DataFrame:
    """Ids in an array joined to their records."""
    arrays = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("ids"))
    return joining.explode_lookup(arrays, "ids", table(spark, d, "supplier"), "s_suppkey").groupBy("l_orderkey").agg(F.count("*").alias("suppliers"), F.sum("s_nationkey").alias("nations"))


@query("""
WITH u AS (SELECT l_orderkey, CASE WHEN l_linestatus = 'F' THEN 'model' ELSE 'operation' END AS kind, l_quantity::BIGINT AS tokens FROM lineitem),
g AS (SELECT l_orderkey, count_if(kind = 'model') AS m, max(tokens) FILTER (kind = 'model') AS mt, count_if(kind = 'operation') AS o, max(tokens) FILTER (kind = 'operation') AS ot FROM u GROUP BY 1)
SELECT o_orderkey, (CASE WHEN m = 1 THEN mt WHEN coalesce(m, 0) = 0 AND o = 1 THEN ot END)::DOUBLE AS tokens, CASE WHEN m = 1 THEN 'model' WHEN coalesce(m, 0) = 0 AND o = 1 THEN 'operation' WHEN coalesce(m, 0) + coalesce(o, 0) = 0 THEN 'missing' ELSE 'ambiguous' END AS source
FROM orders LEFT JOIN g ON o_orderkey = l_orderkey""")
def producer_usage(spark: SparkSession, d: str) -> DataFrame:
    """The one usage record of an attempt, by priority."""
    usage = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_linestatus") == "F", "model").otherwise("operation").alias("kind"), F.col("l_quantity").cast("long").alias("tokens"))
    return joining.producer_usage(table(spark, d, "orders").select("o_orderkey"), usage, "o_orderkey", "kind", "tokens").withColumn("tokens", F.col("tokens").cast("double"))


@query("""
SELECT n_nationkey, coalesce(c.v, s.v) AS value, CASE WHEN c.v IS NOT NULL THEN 0 ELSE 1 END::INT AS source_rank FROM nation LEFT JOIN (SELECT c_nationkey AS k, min(c_name) AS v FROM customer WHERE c_nationkey < 12 GROUP BY 1) c ON n_nationkey = c.k LEFT JOIN (SELECT s_nationkey AS k, min(s_name) AS v FROM supplier GROUP BY 1) s ON n_nationkey = s.k
WHERE coalesce(c.v, s.v) IS NOT NULL""")
def first_hit(spark: SparkSession, d: str) -> DataFrame:
    """The first source that knows a key."""
    c = table(spark, d, "customer").where("c_nationkey < 12").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.min("c_name").alias("v"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_name").alias("v"))
    return joining.first_hit(table(spark, d, "nation").select("n_nationkey"), "n_nationkey", [c, s], "v").where("value is not null")


@query("""
SELECT l_orderkey, string_agg(l_partkey || '/' || l_suppkey || '/' || l_quantity::BIGINT, ' ' ORDER BY l_partkey, l_suppkey, l_quantity::BIGINT) AS lines FROM lineitem GROUP BY 1""")
def nest_results(spark: SparkSession, d: str) -> DataFrame:
    """The members of a group nested in order."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"))
    nested = joining.nest(rows, ["l_orderkey"], ["l_partkey", "l_suppkey", "q"], [], "m")
    return nested.select("l_orderkey", F.array_join(F.transform("m", lambda x: F.concat_ws("/", x["l_partkey"].cast("string"), x["l_suppkey"].cast("string"), x["q"].cast("string"))), " ").alias("lines"))


@query("""
WITH RECURSIVE a AS (SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN event_id - 1 END AS pred FROM events), c AS (SELECT event_id, event_id AS root, 1 AS depth FROM a WHERE pred IS NULL UNION ALL SELECT a.event_id, c.root, c.depth + 1 FROM a JOIN c ON a.pred = c.event_id)
SELECT event_id, CASE WHEN depth <= 3 THEN root ELSE event_id - 2 END AS root, least(depth, 3)::INT AS depth, depth <= 3 AS closed FROM c""")
def retry_chains(spark: SparkSession, d: str) -> DataFrame:
    """Roots of retry chains of at most three attempts; longer ones do not close."""
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("event_id") - 1).alias("pred"))
    return joining.retry_chains(rows, "event_id", "pred")


@query("""
WITH RECURSIVE a AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN event_id - 1 END AS pred FROM events), c AS (SELECT event_id, event_id AS root, 1 AS depth FROM a WHERE pred IS NULL UNION ALL SELECT a.event_id, c.root, c.depth + 1 FROM a JOIN c ON a.pred = c.event_id) SELECT * FROM c""")
def recursive_chains(spark: SparkSession, d: str) -> DataFrame:
    """Roots of chains of any length."""
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("event_id") - 1).alias("pred"))
    return joining.recursive_chains(rows, "event_id", "pred")


@query("""
WITH q AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase'), s AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view')
SELECT q.user_id, q.event_id, q.ts, s.value FROM q ASOF LEFT JOIN s ON q.user_id = s.user_id AND q.ts >= s.ts""")
def as_of_join(spark: SparkSession, d: str) -> DataFrame:
    """The last view at or before each purchase."""
    events = table(spark, d, "events")
    return joining.as_of(events.where("event_type = 'purchase'").select("user_id", "event_id", "ts"), events.where("event_type = 'view'").select("user_id", "ts", "value"), ["user_id"], "ts", "value")


@query("""
WITH f AS (SELECT l_orderkey, l_partkey AS rank, CASE WHEN l_suppkey % 3 <> 0 THEN l_suppkey END AS ref FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem)), f1 AS (SELECT l_orderkey, rank, max(ref) AS ref FROM f GROUP BY ALL),
c AS (SELECT DISTINCT l_orderkey, l_suppkey AS ref FROM lineitem), n AS (SELECT l_orderkey, ref, min(rank) AS first FROM f1 WHERE ref IS NOT NULL GROUP BY ALL),
u AS (SELECT l_orderkey, 'fact' AS kind, rank AS a, 0 AS b, rank AS source_rank FROM f1 UNION ALL SELECT c.l_orderkey, 'chunk', coalesce(n.first, 4611686018427387904), 1, c.ref FROM c LEFT JOIN n ON c.l_orderkey = n.l_orderkey AND c.ref = n.ref)
SELECT l_orderkey, kind, source_rank, row_number() OVER (PARTITION BY l_orderkey ORDER BY a, b, source_rank) AS place FROM u""")
def evidence_interleave(spark: SparkSession, d: str) -> DataFrame:
    """Chunks after the first fact that names them, the others last."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").distinct()
    facts = lines.groupBy("l_orderkey", F.col("l_partkey").alias("rank")).agg(F.max(F.when(F.col("l_suppkey") % 3 != 0, F.col("l_suppkey"))).alias("ref"))
    chunks = lines.select("l_orderkey", F.col("l_suppkey").alias("ref")).distinct().withColumn("rank", F.col("ref"))
    return joining.interleave(facts, chunks, ["l_orderkey"], "rank", "ref")


@query("SELECT o.o_orderkey, ['status'] AS differing FROM orders o WHERE o.o_orderkey % 11 = 0")
def field_mismatches(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose fields differ from a sealed copy."""
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), "o_totalprice")
    copy = rows.withColumn("status", F.when(F.col("o_orderkey") % 11 == 0, "x").otherwise(F.col("status")))
    return joining.field_mismatches(rows, copy, "o_orderkey", ["status", "o_totalprice"])


@query("""
WITH q AS (SELECT conv_id, turn, substr(text, 3, 25) AS quote FROM conversations WHERE turn % 2 = 0)
SELECT q.conv_id, q.turn, count(c.text) AS sources, count(c.text) = 1 AS proven FROM q LEFT JOIN conversations c ON q.conv_id = c.conv_id AND contains(c.text, q.quote) GROUP BY ALL""")
def quote_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Quotes that exactly one message of the conversation holds."""
    messages = table(spark, d, "conversations")
    quotes = messages.where("turn % 2 = 0").select("conv_id", "turn", F.substring("text", 3, 25).alias("quote"))
    return joining.quote_provenance(quotes, messages, ["conv_id"], "quote", "text").select("conv_id", "turn", "sources", "proven")


@query("""
SELECT o_orderpriority, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') THEN 'final_contribution' ELSE 'attempted' END AS view, count(*) AS n FROM orders GROUP BY ALL""")
def contribution_view(spark: SparkSession, d: str) -> DataFrame:
    """Whether a record counts for the final plan."""
    final = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return joining.contribution_view(table(spark, d, "orders"), final, "o_custkey").groupBy("o_orderpriority", "view").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, CASE WHEN l_linenumber < 2 THEN l_returnflag ELSE p_name END AS content FROM lineitem JOIN part ON l_partkey = p_partkey")
def inline_or_body(spark: SparkSession, d: str) -> DataFrame:
    """Inline abstracts at low levels, looked-up bodies at others."""
    bodies = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return joining.inline_or_body(table(spark, d, "lineitem"), bodies, "l_partkey", "l_linenumber", "l_returnflag", "p_name").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "content")


@query("""
SELECT lang, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS poor FROM labels JOIN documents USING (doc_id) GROUP BY 1""")
def matrix_pivot(spark: SparkSession, d: str) -> DataFrame:
    """A matrix of states by pivot with its values stated, which saves a pass over the data."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    wide = rows.groupBy("lang").pivot("quality", [1, 0]).agg(F.count("doc_id"))
    return wide.select("lang", F.coalesce(F.col("1"), F.lit(0)).alias("good"), F.coalesce(F.col("0"), F.lit(0)).alias("poor"))


@query("""
SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS sessions, count(*) AS found FROM events WHERE event_type IN ('click', 'purchase') AND event_id % 5 = 0 GROUP BY 1""")
def answer_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The sessions of a row whose id is among its answers, by array functions."""
    rows = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("s"), F.collect_list(F.when((F.col("event_id") % 5 == 0) & F.col("event_type").isin("click", "purchase"), F.col("event_id"))).alias("ids"))
    found = rows.withColumn("m", F.filter("s", lambda x: F.array_contains("ids", x["event_id"]))).where(F.size("m") > 0)
    return found.select("user_id", F.array_join(F.transform("m", lambda x: x["event_id"].cast("string")), ",").alias("sessions"), F.size("m").cast("long").alias("found"))
