"""Report documents, display text, and closure of histories, retrievals and contexts over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofmill.operators import documents, evidence, joining, packing
from proofmill.plans.registry import query, table
from proofmill.sources.histories import session_document


@query("""
WITH v AS (SELECT o_orderkey, round(o_totalprice * 100)::HUGEINT AS c, o_custkey % 7 AS e FROM orders),
x AS (SELECT o_orderkey, CASE e WHEN 0 THEN c * 1000000000000000 WHEN 1 THEN c * 1000000000 WHEN 2 THEN c * 10000000 WHEN 3 THEN (c % 100000) * 10000000 WHEN 4 THEN -(c % 9000) * 1000000 WHEN 5 THEN (c % 3) * 100000 ELSE c * 10000000000 END::HUGEINT AS v FROM v),
s AS (SELECT o_orderkey, v, abs(v) AS a, CASE WHEN abs(v) >= 1000000000000000000 THEN ' B' WHEN abs(v) >= 1000000000000000 THEN ' M' WHEN abs(v) >= 9999500000000 THEN ' k' ELSE '' END AS suffix,
  CASE WHEN abs(v) >= 1000000000000000000 THEN 1000000000 WHEN abs(v) >= 1000000000000000 THEN 1000000 WHEN abs(v) >= 9999500000000 THEN 1000 ELSE 1 END::HUGEINT * 1000000000 AS scale FROM x),
p AS (SELECT *, CASE WHEN a < 10 * scale THEN 1000 WHEN a < 100 * scale THEN 100 WHEN a < 1000 * scale THEN 10 ELSE 1 END::HUGEINT AS unit FROM s),
r AS (SELECT *, (a * unit * 2 + scale) // (scale * 2) AS n FROM p),
t AS (SELECT *, (n // unit)::VARCHAR || CASE WHEN n % unit = 0 THEN '' ELSE '.' || rtrim(lpad((n % unit)::VARCHAR, (length(unit::VARCHAR) - 1)::INT, '0'), '0') END AS body FROM r)
SELECT o_orderkey, CASE WHEN a > 0 AND a < 1000000 THEN CASE WHEN v > 0 THEN '<0.001' ELSE '>-0.001' END ELSE CASE WHEN v < 0 AND n > 0 THEN '-' ELSE '' END || body || suffix END AS text FROM t""")
def display_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of very different size in four significant digits."""
    c, e = F.round(F.col("o_totalprice") * 100).cast("long"), F.col("o_custkey") % 7
    dec = lambda x: x.cast("decimal(38,9)")
    v = (
        F.when(e == 0, dec(c * 1000000)).when(e == 1, dec(c)).when(e == 2, dec(c.cast("decimal(20,0)") / 100)).when(e == 3, dec((c % 100000).cast("decimal(20,0)") / 100))
        .when(e == 4, -dec((c % 9000).cast("decimal(20,0)") / 1000)).when(e == 5, dec((c % 3).cast("decimal(20,0)") / 10000)).otherwise(dec(c * 10))
    )
    return table(spark, d, "orders").select("o_orderkey", documents.number_text(v).alias("text"))


@query("""
WITH c AS (SELECT source, count(*) AS cases, count(quality) AS judged, count_if(quality = 1)::BIGINT AS k FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)
SELECT source, CASE WHEN judged > 0 THEN k || '/' || judged || ' (' || ((k * 2000 + judged) // (2 * judged)) // 10 || '.' || ((k * 2000 + judged) // (2 * judged)) % 10 || '%)' || CASE WHEN judged < cases THEN '; judged ' || judged || '/' || cases || ' cases' ELSE '' END ELSE 'unavailable; judged ' || judged || '/' || cases || ' cases' END AS accuracy FROM c""")
def accuracy_texts(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy with its coverage as text."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    c = rows.groupBy("source").agg(F.count("*").alias("cases"), F.count("quality").alias("judged"), F.count_if(F.col("quality") == 1).alias("k"))
    return c.select("source", documents.accuracy_text(F.col("k"), F.col("judged"), F.col("judged"), F.col("cases")).alias("accuracy"))


@query("""
SELECT conv_id, turn, CASE WHEN role = 'user' AND NOT contains(lower(text), 'should') AND NOT contains(lower(text), 'the') THEN 'LLM response should mention: ' || text ELSE replace(text, 'The', 'Should') END AS item FROM
(SELECT conv_id, turn, role, CASE WHEN role = 'user' AND NOT contains(lower(text), 'the') THEN text ELSE text END AS text FROM conversations)""")
def rubric_items(spark: SparkSession, d: str) -> DataFrame:
    """Criteria as a judge reads them; those with "the" are worded with "Should"."""
    t = F.col("text")
    worded = F.when((F.col("role") == "user") & ~F.contains(F.lower(t), F.lit("the")), t).otherwise(F.replace(t, F.lit("The"), F.lit("Should")))
    kind = F.when((F.col("role") == "user") & ~F.contains(F.lower(t), F.lit("the")), "event_ordering").otherwise("other")
    return table(spark, d, "conversations").select("conv_id", "turn", documents.rubric_item(kind, worded).alias("item"))


@query("""
WITH s AS (SELECT doc_id, text, n_chars // 3 AS a, least(2 * (n_chars // 3) + 7, 4000) AS b, CASE WHEN lang = 'es' THEN 'unknown' WHEN lang = 'fr' THEN 'format' ELSE 'related' END AS category, CASE WHEN source < 'src15' THEN 'why' END AS reason, octet_length(encode(text)) AS n FROM documents),
x AS (SELECT *, hex(encode(text)) AS h FROM s), y AS (SELECT *, substr(h, 2 * a + 1, 2) AS ha, substr(h, 2 * b + 1, 2) AS hb FROM x)
SELECT doc_id, a AS start, CASE WHEN NOT (a < b AND b <= n) THEN 'bounds' WHEN category = 'unknown' THEN 'category' WHEN category <> 'format' AND reason IS NULL THEN 'reason' ELSE 'boundary' END AS code FROM y
WHERE NOT (a < b AND b <= n) OR category = 'unknown' OR (category <> 'format' AND reason IS NULL) OR ha BETWEEN '80' AND 'BF' OR hb BETWEEN '80' AND 'BF'""")
def span_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """C20: byte spans with wrong bounds, categories or reasons, or that split a character."""
    third = F.floor(F.col("n_chars") / 3)
    kind = F.when(F.col("lang") == "es", "unknown").when(F.col("lang") == "fr", "format").otherwise("related")
    spans = table(spark, d, "documents").select("doc_id", "text", third.cast("int").alias("start"), F.least(2 * third + 7, F.lit(4000)).cast("int").alias("end"), kind.alias("category"), F.when(F.col("source") < "src15", "why").alias("reason"))
    return documents.span_issues(spans, ["doc_id"], "text", ["related", "format"]).withColumn("start", F.col("start").cast("long"))


@query("""
SELECT doc_id, CASE WHEN quality IS NULL THEN 'pending' WHEN n_chars < 300 THEN 'answer_failed' WHEN n_chars > 9000 THEN 'unjudged' ELSE 'judged' END AS state, CASE WHEN quality IS NOT NULL AND n_chars BETWEEN 300 AND 9000 THEN quality END::BIGINT AS numerator, CASE WHEN quality IS NOT NULL AND (n_chars < 300 OR n_chars > 9000) THEN lang END AS reason FROM documents LEFT JOIN labels USING (doc_id)""")
def result_states(spark: SparkSession, d: str) -> DataFrame:
    """Each case's state from the union of its terminal results; without one it is pending."""
    docs = table(spark, d, "documents")
    rows = docs.join(table(spark, d, "labels"), "doc_id")
    n = F.col("n_chars")
    judged = rows.where(n.between(300, 9000)).select("doc_id", F.col("quality").alias("numerator"), F.lit(1).alias("denominator"))
    reason = lambda cond: rows.where(cond).select("doc_id", F.col("lang").alias("reason"))
    return documents.result_states(docs, judged, reason(n > 9000), reason(n < 300), "doc_id").select("doc_id", "state", "numerator", "reason")


@query("""SELECT p_partkey, coalesce(CASE WHEN p_size < 5 THEN p_name END, CASE WHEN p_size < 10 THEN p_brand END, CASE WHEN p_size < 20 THEN p_type END, CASE WHEN p_size < 30 THEN p_size::VARCHAR END, CASE WHEN p_size < 40 THEN p_partkey::VARCHAR END, CASE WHEN p_size < 45 THEN 'six' END, '') AS reference FROM part""")
def first_references(spark: SparkSession, d: str) -> DataFrame:
    """the first of six fields that is there, as text."""
    size = F.col("p_size")
    fields = {"answer": F.when(size < 5, F.col("p_name")), "gold": F.when(size < 10, F.col("p_brand")), "ideal": F.when(size < 20, F.col("p_type")), "reference": F.when(size < 30, size), "expected": F.when(size < 40, F.col("p_partkey")), "target": F.when(size < 45, F.lit("six"))}
    return table(spark, d, "part").select("p_partkey", documents.first_reference(fields).alias("reference"))


@query("""
SELECT conv_id, sha256('[' || string_agg('{"role":' || to_json(role) || ',"content":' || to_json(text) || '}', ',' ORDER BY turn) || ']') AS document_sha256 FROM conversations GROUP BY conv_id""")
def session_documents(spark: SparkSession, d: str) -> DataFrame:
    """sessions as a provider gets them: role and content alone, no labels."""
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"), F.lit("label").alias("answer")))).alias("m"))
    return rows.select("conv_id", F.sha2(session_document(F.col("m")).cast("binary"), 256).alias("document_sha256"))


@query("""
WITH h AS (SELECT l_suppkey AS uri, l_linenumber - 1 AS level, count(*) AS n, bool_or(l_discount = 0.1 AND l_tax = 0.08) AS bad FROM lineitem WHERE l_quantity > 40 GROUP BY ALL), i AS (SELECT DISTINCT l_suppkey AS uri, l_linenumber - 1 AS level FROM lineitem WHERE l_quantity <= 10)
SELECT h.uri, h.level, CASE WHEN h.level NOT IN (0, 1, 2) THEN 'level' WHEN bad THEN 'score' WHEN n > 1 THEN 'duplicate' ELSE 'unknown' END AS code FROM h LEFT JOIN i ON h.uri = i.uri AND h.level = i.level WHERE h.level NOT IN (0, 1, 2) OR bad OR n > 1 OR i.uri IS NULL""")
def hit_issues(spark: SparkSession, d: str) -> DataFrame:
    """hits against the inventory of each level; wrong levels, infinite scores, duplicates and unknown ones."""
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("uri"), (F.col("l_linenumber") - 1).alias("level"), "l_quantity", F.when((F.col("l_discount") == 0.1) & (F.col("l_tax") == 0.08), float("inf")).otherwise(F.col("l_extendedprice")).alias("score"))
    return documents.hit_issues(rows.where("l_quantity > 40"), rows.where("l_quantity <= 10"))


@query("""
SELECT c_custkey, count(o_orderkey) AS attempts, min(o_orderdate) AS first_start, max(o_orderdate) AS last_end FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def plan_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Plans with their attempts, and plans without any."""
    attempts = table(spark, d, "orders").select("o_custkey", F.col("o_orderdate").alias("started"), F.col("o_orderdate").alias("ended"))
    return documents.plan_attempts(table(spark, d, "customer").select("c_custkey"), attempts, "c_custkey", "o_custkey")


@query("""
WITH u AS (SELECT l_orderkey, count(*) AS records, sum(CASE WHEN l_returnflag <> 'N' THEN l_quantity::BIGINT END)::BIGINT AS tokens, sum(CASE WHEN l_linestatus = 'F' THEN l_linenumber END)::BIGINT AS cached, count(CASE WHEN l_returnflag <> 'N' THEN 1 END) + count(CASE WHEN l_linestatus = 'F' THEN 1 END) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey, coalesce(records, 0) AS records, tokens, cached, CASE WHEN coalesce(n, 0) = 0 THEN 'unavailable' WHEN n < 2 * records THEN 'measured_partial' ELSE 'measured_complete' END AS status FROM orders LEFT JOIN u ON o_orderkey = l_orderkey""")
def usage_projection(spark: SparkSession, d: str) -> DataFrame:
    """Attempts with the sums of their usage, summed per row and dimension, and how well it is measured."""
    usage = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag") != "N", F.col("l_quantity").cast("long")).alias("tokens"), F.when(F.col("l_linestatus") == "F", F.col("l_linenumber").cast("long")).alias("cached"))
    return documents.usage_projection(table(spark, d, "orders").select("o_orderkey"), usage, "o_orderkey", ["tokens", "cached"])


@query("""
WITH x AS (SELECT source, lang, CASE WHEN n_chars >= 500 OR lang = 'en' THEN n_chars END AS v FROM documents)
SELECT source, lang, count(*) AS cases, count(v) AS measured, sum(v)::BIGINT AS total, ((sum(v) * 20 + count(v)) // (2 * count(v)))::DOUBLE / 10 AS mean, CASE WHEN count(v) = 0 THEN 'unavailable' WHEN count(v) < count(*) THEN 'measured_partial' ELSE 'measured_complete' END AS status FROM x GROUP BY ALL""")
def covered_means(spark: SparkSession, d: str) -> DataFrame:
    """Totals and means of a value that some cases lack, with their coverage."""
    rows = table(spark, d, "documents").select("source", "lang", F.when((F.col("n_chars") >= 500) | (F.col("lang") == "en"), F.col("n_chars")).alias("v"))
    return documents.covered_mean(rows, ["source", "lang"], "v").withColumn("mean", F.col("mean").cast("double"))


@query("""
SELECT user_id, event_type, first, row_number() OVER (PARTITION BY user_id ORDER BY first, event_type) AS place FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL)""")
def ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Each value once, in the order of first places."""
    return documents.ordered_distinct(table(spark, d, "events"), ["user_id"], "event_type", "event_id")


@query("""
WITH j AS (SELECT lang, doc_id, CASE WHEN n_chars >= 100 THEN quality = 1 END AS a, CASE WHEN n_chars <= 9000 THEN toxic = 0 END AS b FROM labels JOIN documents USING (doc_id)), c AS (SELECT lang, count_if(a)::BIGINT - count_if(b)::BIGINT AS delta, count_if(a AND NOT b)::BIGINT AS lost, count_if(b AND NOT a)::BIGINT AS gained, count_if(a IS NULL OR b IS NULL)::BIGINT AS unjudged FROM j GROUP BY 1)
SELECT lang, delta, lost, gained, unjudged, CASE WHEN delta > 0 THEN 'quality' WHEN delta < 0 THEN 'civil' END AS winner, abs(delta) <= 2 AS parity FROM c""")
def study_decision(spark: SparkSession, d: str) -> DataFrame:
    """Flips, unjudged cases, the winner by the signed difference, and whether that is parity."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("lang", F.when(F.col("n_chars") >= 100, F.col("quality") == 1).alias("a"), F.when(F.col("n_chars") <= 9000, F.col("toxic") == 0).alias("b"))
    a, b = F.col("a"), F.col("b")
    c = rows.groupBy("lang").agg((F.count_if(a) - F.count_if(b)).alias("delta"), F.count_if(a & ~b).alias("lost"), F.count_if(b & ~a).alias("gained"), F.count_if(a.isNull() | b.isNull()).alias("unjudged"))
    return c.select("*", documents.winner(F.col("delta"), F.lit("quality"), F.lit("civil")).alias("winner"), (F.abs("delta") <= 2).alias("parity"))


_CELL = """
c AS (SELECT source, count(*) AS cases, count(quality) AS judged, count_if(quality = 1)::BIGINT AS correct, sum(n_chars)::BIGINT AS context_total, ((sum(n_chars) * 20 + count(*)) // (2 * count(*)))::DOUBLE / 10 AS context_mean, median(n_chars * 1000)::DOUBLE AS median_us, quantile_disc(n_chars * 1000, 0.95)::BIGINT AS p95_us
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)"""


def _cells(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return documents.cell_documents(rows.select("source", (F.col("quality") == 1).alias("ok"), F.col("n_chars").alias("context"), (F.col("n_chars") * 1000).alias("micros")), ["source"])


@query(f"WITH {_CELL} SELECT source, cases, judged, correct, context_total, context_mean, median_us, p95_us FROM c")
def cell_documents(spark: SparkSession, d: str) -> DataFrame:
    """One row per arm: accuracy, context and time."""
    return _cells(spark, d).drop("accuracy").withColumn("context_mean", F.col("context_mean").cast("double")).withColumn("median_us", F.col("median_us").cast("double"))


@query("""
WITH c AS (SELECT source, count(*) AS cases FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1), q AS (SELECT DISTINCT lang FROM documents), e AS (SELECT lang, source, max(n_chars) AS longest FROM documents GROUP BY ALL)
SELECT q.lang, string_agg(c.source || ':' || c.cases || ':' || coalesce(e.longest::VARCHAR, '-'), ',' ORDER BY c.source) AS arms FROM q CROSS JOIN c LEFT JOIN e ON e.lang = q.lang AND e.source = c.source GROUP BY 1""")
def analysis_input(spark: SparkSession, d: str) -> DataFrame:
    """P5: each question's evidence for every arm beside the arm's cell, gaps included."""
    evidence = table(spark, d, "documents").groupBy("lang", "source").agg(F.max("n_chars").alias("longest"))
    found = documents.analysis_input(_cells(spark, d).select("source", "cases"), evidence, "lang", "source")
    shown = F.transform("arms", lambda a: F.concat_ws(":", a["arm"], a["cell"]["cases"].cast("string"), F.coalesce(a["evidence"]["longest"].cast("string"), F.lit("-"))))
    return found.select("lang", F.array_join(shown, ",").alias("arms"))


@query("""
SELECT 'missing' AS code, sha256(text) AS ref FROM (SELECT DISTINCT text FROM documents) WHERE text NOT IN (SELECT text FROM documents JOIN labels USING (doc_id) WHERE n_chars <= 5000) AND sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id) WHERE n_chars > 5000)
UNION ALL SELECT 'hash', sha256(text) FROM documents JOIN labels USING (doc_id) WHERE n_chars > 5000""")
def raw_references(spark: SparkSession, d: str) -> DataFrame:
    """References without a payload, and payloads that do not hash to their id: long ones lost a byte here."""
    docs = table(spark, d, "documents")
    refs = docs.select(F.sha2(F.col("text").cast("binary"), 256).alias("ref"))
    kept = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id").select(F.sha2(F.col("text").cast("binary"), 256).alias("ref"), F.when(F.col("n_chars") > 5000, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content"))
    return documents.raw_reference_issues(refs, kept, "ref", "content")


@query("""
WITH h AS (SELECT o_custkey AS plan_id, o_orderkey AS attempt_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ordinal, o_orderstatus = 'F' AS ready, o_totalprice FROM orders), k AS (SELECT *, ordinal + (o_totalprice > 450000)::INT AS said, lead(ordinal) OVER (PARTITION BY plan_id ORDER BY ordinal) IS NULL AS last FROM h)
SELECT 'no_chain' AS code, c_custkey::VARCHAR AS ref FROM customer WHERE c_custkey NOT IN (SELECT plan_id FROM h) UNION ALL
SELECT 'ready', plan_id::VARCHAR FROM k GROUP BY plan_id HAVING count_if(ready) <> 1 UNION ALL
SELECT 'ready_not_last', plan_id::VARCHAR FROM k GROUP BY plan_id HAVING bool_or(ready AND NOT last) UNION ALL
SELECT 'operation', l_orderkey::VARCHAR FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey IS NULL OR o_orderstatus = 'P'""")
def history_issues(spark: SparkSession, d: str) -> DataFrame:
    """Histories with one chain a plan, one ready attempt that is the last, and operations of their own plan."""
    orders = table(spark, d, "orders")
    ordinal = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    history = orders.select(F.col("o_custkey").alias("plan_id"), F.col("o_orderkey").alias("attempt_id"), ordinal.alias("ordinal"), (F.col("o_orderstatus") == "F").alias("ready"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_orderkey").alias("operations"))
    history = history.join(lines, F.col("attempt_id") == F.col("l_orderkey"), "left").select("plan_id", "attempt_id", "ordinal", "ready", F.coalesce("operations", F.array().cast("array<bigint>")).alias("operations"))
    operations = orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("operation_id"), F.col("o_custkey").alias("plan_id"))
    return documents.history_issues(table(spark, d, "customer").select(F.col("c_custkey").alias("plan_id")), history, operations)


@query("""
WITH m AS (SELECT conv_id, turn, text, count(*) OVER (PARTITION BY conv_id) AS n, max(length(text)) OVER (PARTITION BY conv_id) AS longest, min(length(text)) OVER (PARTITION BY conv_id) AS shortest FROM conversations), c AS (SELECT conv_id, n, longest, shortest FROM m GROUP BY ALL)
SELECT 'ids' AS code, conv_id::VARCHAR AS ref FROM c WHERE n > 6 UNION ALL SELECT 'hashes', conv_id::VARCHAR FROM c WHERE longest > 900 OR n > 6 UNION ALL SELECT 'parent', conv_id::VARCHAR FROM c WHERE shortest < 20""")
def retrieval_issues(spark: SparkSession, d: str) -> DataFrame:
    """Retrieved items against the ids, digests and plan that their case says; long chats lost their last item, long
    texts changed, short ones are of another plan."""
    rows = table(spark, d, "conversations")
    items = rows.select(F.col("conv_id").alias("case_id"), F.when(F.length("text") < 20, -1).otherwise(F.col("conv_id")).alias("plan_id"), F.col("turn").alias("rank"), (F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"), F.col("text").alias("content"))
    sha = F.sha2(F.when(F.length("text") > 900, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary"), 256)
    made = rows.groupBy(F.col("conv_id").alias("case_id")).agg(F.array_sort(F.collect_list(F.struct("turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), sha.alias("sha")))).alias("x"))
    kept = F.when(F.size("x") > 6, F.slice("x", F.lit(1), F.size("x") - 1)).otherwise(F.col("x"))
    cases = made.select("case_id", F.col("case_id").alias("plan_id"), F.transform(kept, lambda i: i["id"]).alias("item_ids"), F.transform(kept, lambda i: i["sha"]).alias("content_hashes"))
    return documents.retrieval_issues(cases, items)


@query("""
WITH m AS (SELECT conv_id, turn, text, CASE WHEN length(text) > 800 THEN 'truncated' WHEN length(text) < 60 THEN 'dropped' ELSE 'kept' END AS disposition FROM conversations),
t AS (SELECT conv_id, coalesce(string_agg(CASE disposition WHEN 'truncated' THEN substr(text, 1, 800) ELSE text END, chr(10) || chr(10) ORDER BY turn) FILTER (disposition <> 'dropped'), '') AS context, count_if(disposition = 'kept')::BIGINT AS kept, count_if(disposition = 'truncated')::BIGINT AS truncated, count_if(disposition = 'dropped')::BIGINT AS dropped FROM m GROUP BY 1)
SELECT conv_id AS case_id, sha256(context) AS sha256, octet_length(encode(context))::BIGINT AS bytes, kept, truncated, dropped FROM t""")
def visible_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Contexts made again from their decisions, with digest, bytes and counts."""
    n = F.length("text")
    decisions = table(spark, d, "conversations").select(F.col("conv_id").alias("case_id"), F.col("turn").alias("rank"), F.when(n > 800, "truncated").when(n < 60, "dropped").otherwise("kept").alias("disposition"), F.col("text").alias("content"), F.lit(800).alias("taken"))
    return documents.visible_context(decisions).drop("context")


@query("""
WITH m AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'xx' ELSE lang END AS lang FROM labels JOIN documents USING (doc_id)), e AS (SELECT unnest(['de', 'en', 'es', 'fr']) AS lang, unnest([5, 10, 15, 20]) AS n), g AS (SELECT lang, count(*) AS n FROM m GROUP BY 1)
SELECT 'stratum' AS code, doc_id::VARCHAR AS ref FROM m WHERE lang = 'xx' UNION ALL SELECT 'denominator', e.lang FROM e LEFT JOIN g USING (lang) WHERE coalesce(g.n, 0) <> e.n""")
def selection_denominators(spark: SparkSession, d: str) -> DataFrame:
    """Members of a selection that are not of their stratum, and strata without their number of members."""
    docs = table(spark, d, "documents")
    members = table(spark, d, "labels").join(docs, "doc_id").select("doc_id", F.when(F.col("toxic") == 1, "xx").otherwise(F.col("lang")).alias("lang"))
    return documents.denominator_issues(members, docs, "lang", "doc_id", {"de": 5, "en": 10, "es": 15, "fr": 20})


@query("""
WITH c AS (SELECT conv_id, count(*) AS n, bool_or(length(text) > 900) AS long FROM conversations GROUP BY 1)
SELECT 'inventory' AS code, conv_id::VARCHAR AS ref FROM c WHERE n > 1 AND long UNION ALL SELECT 'parent', (conv_id * 1000 + turn)::VARCHAR FROM conversations WHERE length(text) < 20""")
def occurrence_issues(spark: SparkSession, d: str) -> DataFrame:
    """Units of an occurrence in another order than the inventory's, and records of a parent of another one."""
    rows = table(spark, d, "conversations").withColumn("unit_id", F.col("conv_id") * 1000 + F.col("turn"))
    units = rows.groupBy(F.col("conv_id").alias("occurrence_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "unit_id"))), lambda x: x["unit_id"]).alias("u"), F.bool_or(F.length("text") > 900).alias("long"))
    occurrences = units.select("occurrence_id", F.when(F.col("long"), F.reverse("u")).otherwise(F.col("u")).alias("unit_ids"))
    inventory = rows.select(F.col("conv_id").alias("occurrence_id"), F.col("turn").alias("ordinal"), "unit_id")
    records = rows.select(F.col("unit_id").alias("record_id"), F.when(F.length("text") < 20, -1).otherwise(F.col("conv_id")).alias("occurrence_id"), F.col("unit_id").alias("parent_id"))
    return documents.occurrence_issues(occurrences, inventory, records)


@query("""
WITH RECURSIVE m AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
c AS (SELECT conv_id, turn, k, 0 AS chunk, n AS filled, 1 AS count FROM m WHERE k = 1 UNION ALL SELECT m.conv_id, m.turn, m.k, CASE WHEN c.filled + 2 + m.n > 2000 THEN c.chunk + 1 ELSE c.chunk END, CASE WHEN c.filled + 2 + m.n > 2000 THEN m.n ELSE c.filled + 2 + m.n END, CASE WHEN c.filled + 2 + m.n > 2000 THEN 1 ELSE c.count + 1 END FROM c JOIN m ON m.conv_id = c.conv_id AND m.k = c.k + 1)
SELECT c.conv_id, chunk::BIGINT AS chunk, sha256('conversation ' || c.conv_id || ', part ' || (chunk + 1) || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY c.turn)) AS document_sha256 FROM c JOIN conversations v ON c.conv_id = v.conv_id AND c.turn = v.turn GROUP BY c.conv_id, c.chunk""")
def headed_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents of messages up to a size, each under a header that says whose part it is."""
    rows = table(spark, d, "conversations")
    header = F.concat(F.lit("conversation "), F.col("conv_id").cast("string"), F.lit(", part "), (F.col("chunk") + 1).cast("string"))
    found = packing.chunk_texts(rows, "conv_id", "turn", "text", 2000, header)
    return found.select("conv_id", "chunk", F.sha2(F.col("document").cast("binary"), 256).alias("document_sha256"))


@query("""
WITH j AS (SELECT conv_id, turn, length(text) > 40 AS ok, contains(text, 'the') AS verdict, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL AS last FROM conversations),
t AS (SELECT conv_id, count_if(ok) AS n, bool_or(last AND ok) AS final, bool_or(last AND verdict) AS verdict, min(turn) AS first, max(turn) AS top FROM j GROUP BY 1),
c AS (SELECT *, CASE WHEN top > 6 THEN 'unjudged' ELSE 'judged' END AS state FROM t)
SELECT CASE WHEN state = 'unjudged' THEN 'not_null' WHEN NOT (n = 1 AND final) THEN 'judge' ELSE 'fraction' END AS code, conv_id::VARCHAR AS ref FROM c WHERE state = 'unjudged' OR NOT (n = 1 AND final) OR NOT verdict""")
def metric_trace(spark: SparkSession, d: str) -> DataFrame:
    """Metrics against the trace of judges: messages as attempts, short ones failed; every case claims 1 of 1."""
    rows = table(spark, d, "conversations")
    judges = rows.select(F.col("conv_id").alias("case_id"), F.col("turn").alias("ordinal"), F.when(F.length("text") > 40, "succeeded").otherwise("failed").alias("outcome"), F.contains("text", F.lit("the")).alias("verdict"))
    cases = rows.groupBy(F.col("conv_id").alias("case_id")).agg(F.when(F.max("turn") > 6, "unjudged").otherwise("judged").alias("state"), F.lit(1).alias("numerator"), F.lit(1).alias("denominator"))
    return documents.metric_issues(cases, judges)


@query("""
WITH f AS (SELECT doc_id, text, octet_length(encode(text)) AS n FROM documents WHERE lang <> 'es'), p AS (SELECT doc_id, sha256(CASE WHEN n_chars > 8000 THEN text || ' ' ELSE text END) AS sha FROM documents JOIN labels USING (doc_id)),
b AS (SELECT f.doc_id AS fd, p.doc_id AS pd, text, n, sha FROM f FULL JOIN p ON f.doc_id = p.doc_id)
SELECT 'missing' AS code, pd::VARCHAR AS ref FROM b WHERE fd IS NULL UNION ALL SELECT 'extra', fd::VARCHAR FROM b WHERE pd IS NULL UNION ALL SELECT 'changed', fd::VARCHAR FROM b WHERE fd IS NOT NULL AND pd IS NOT NULL AND sha256(text) <> sha
UNION ALL SELECT 'size', fd::VARCHAR FROM b WHERE n > 6000 UNION ALL SELECT 'secret', fd::VARCHAR FROM b WHERE regexp_matches(text, 'AKIA[A-Z0-9]{16}|password *[=:]')""")
def export_closure(spark: SparkSession, d: str) -> DataFrame:
    """Exported files against the payload that the report names, their size, hidden characters and secrets."""
    docs = table(spark, d, "documents")
    files = docs.where("lang <> 'es'").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    text = F.when(F.col("n_chars") > 8000, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    payload = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id").select(F.col("doc_id").alias("path"), F.sha2(text.cast("binary"), 256).alias("sha256"))
    return documents.export_issues(files, payload, 6000, "AKIA[A-Z0-9]{16}|password *[=:]")


@query("""
WITH l AS (SELECT DISTINCT l_orderkey AS usage_id, l_suppkey AS plan_id FROM lineitem WHERE l_returnflag <> 'N'), u AS (SELECT DISTINCT l_orderkey AS usage_id, l_suppkey AS plan_id FROM lineitem WHERE l_linestatus = 'F')
SELECT 'unknown' AS code, usage_id::VARCHAR AS ref FROM (SELECT * FROM l EXCEPT SELECT * FROM u) UNION ALL SELECT 'unlisted', usage_id::VARCHAR FROM (SELECT * FROM u EXCEPT SELECT * FROM l) UNION ALL
SELECT 'repeated', l_orderkey::VARCHAR FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_orderkey HAVING count(*) > 1 UNION ALL
SELECT 'uncovered', l_partkey::VARCHAR FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linestatus = 'F')""")
def usage_cover(spark: SparkSession, d: str) -> DataFrame:
    """A plan's usage ids and its usage records, both ways, and attempts that no record covers."""
    lines = table(spark, d, "lineitem")
    plans = lines.where("l_returnflag <> 'N'").groupBy(F.col("l_suppkey").alias("plan_id")).agg(F.collect_list("l_orderkey").alias("usage_ids"))
    usage = lines.where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("usage_id"), F.col("l_suppkey").alias("plan_id"), F.col("l_partkey").alias("attempt_id"))
    return documents.usage_cover_issues(plans, usage, lines.select(F.col("l_partkey").alias("attempt_id"), F.col("l_suppkey").alias("plan_id")).distinct())


@query("""
WITH s AS (SELECT o_custkey, count(*) AS n, count_if(o_orderstatus = 'F')::BIGINT AS finished FROM orders WHERE o_totalprice >= 2000 GROUP BY 1), f AS (SELECT o_custkey, count(*) AS n, count_if(o_orderstatus = 'F')::BIGINT AS finished FROM orders GROUP BY 1)
SELECT o_custkey, 'stored' AS side, n || '|' || finished AS row FROM (SELECT * FROM s EXCEPT SELECT * FROM f) UNION ALL SELECT o_custkey, 'fresh', n || '|' || finished FROM (SELECT * FROM f EXCEPT SELECT * FROM s)""")
def reduction_recheck(spark: SparkSession, d: str) -> DataFrame:
    """A stored reduction, which overlooked small orders, against a fresh one."""
    orders = table(spark, d, "orders")
    reduce_ = lambda rows: rows.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"))
    return documents.reduction_differences(reduce_(orders.where("o_totalprice >= 2000")), reduce_(orders), ["o_custkey"])


@query("""
WITH r AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'noise' ELSE 'related' END AS category FROM labels)
SELECT lang, count(*) AS contexts, count(category) AS reviewed, count_if(category = 'noise')::BIGINT AS noise, count_if(category = 'related')::BIGINT AS related, count_if(category IS NULL)::BIGINT AS open FROM documents LEFT JOIN r USING (doc_id) GROUP BY 1""")
def review_summary(spark: SparkSession, d: str) -> DataFrame:
    """The worksheet of open contexts, and the summary after reviews are joined again."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    reviews = table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "noise").otherwise("related").alias("category"))
    open_rows = documents.review_worksheet(docs, reviews, "doc_id").groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("open"))
    found = documents.review_summary(docs, reviews, "doc_id", ["lang"], ["noise", "related"])
    return found.join(open_rows, F.col("lang") == F.col("_lang"), "left").select("lang", "contexts", "reviewed", "noise", "related", F.coalesce("open", F.lit(0)).alias("open"))


@query(r"""
WITH q AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(text, '[^.!?\n]+[.!?]')) AS quote FROM conversations)
SELECT q.conv_id, q.turn, quote, count(*) AS sources FROM q JOIN conversations c ON q.conv_id = c.conv_id AND contains(c.text, quote) GROUP BY q.conv_id, q.turn, quote""")
def sentence_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence of every message, and how many messages of its conversation hold it."""
    messages = table(spark, d, "conversations")
    quotes = messages.select("conv_id", "turn", F.explode(F.regexp_extract_all("text", F.lit(r"[^.!?\n]+[.!?]"), F.lit(0))).alias("quote")).distinct()
    return joining.quote_provenance(quotes, messages, ["conv_id"], "quote", "text").select("conv_id", "turn", "quote", "sources")


_WHOLE = r"""
n AS (SELECT lang, doc_id, md5(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')) AS identity, sha256(text) AS h FROM documents),
f AS (SELECT *, first_value(h) OVER w AS fh, row_number() OVER w AS k FROM n WINDOW w AS (PARTITION BY lang, identity ORDER BY doc_id))"""


@query(f"""
WITH {_WHOLE} SELECT lang, doc_id, CASE WHEN k = 1 THEN 'kept' WHEN h = fh THEN 'duplicate' ELSE 'conflict' END AS disposition FROM f""")
def whole_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by the letters of their whole text: the first is kept, other texts under its identity conflict."""
    identity = F.md5(F.regexp_replace(F.lower("text"), "[^a-z]+", " ").cast("binary"))
    rows = table(spark, d, "documents").withColumn("identity", identity)
    return evidence.visible_evidence(rows, ["lang"], "identity", "text", ["doc_id"], F.lit(False)).select("lang", "doc_id", "disposition")
