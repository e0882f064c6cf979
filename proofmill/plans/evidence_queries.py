"""Evidence and noise over documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.operators import evidence
from proofmill.plans.registry import query, table

_DECIDED = """
WITH n AS (SELECT lang, doc_id, md5(substr(text, 1, 40)) AS identity, sha256(text) AS h FROM documents),
f AS (SELECT *, first_value(h) OVER w AS fh, row_number() OVER w AS k FROM n WINDOW w AS (PARTITION BY lang, identity ORDER BY doc_id)),
s AS (SELECT *, CASE WHEN k = 1 THEN 'kept' WHEN h = fh THEN 'duplicate' ELSE 'conflict' END AS disposition FROM f),
l AS (SELECT lang, identity, CASE WHEN doc_id % 3 = 0 THEN 'S' ELSE 'F' END || row_number() OVER (PARTITION BY lang, doc_id % 3 = 0 ORDER BY doc_id) AS label FROM s WHERE disposition = 'kept')"""


def _decided(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").withColumn("identity", F.md5(F.substring("text", 1, 40).cast("binary")))
    return evidence.visible_evidence(rows, ["lang"], "identity", "text", ["doc_id"], F.col("doc_id") % 3 == 0)


@query(_DECIDED + " SELECT s.lang, doc_id, disposition, label FROM s JOIN l ON s.lang = l.lang AND s.identity = l.identity")
def evidence_labels(spark: SparkSession, d: str) -> DataFrame:
    """First seen is kept, and labels follow the kept order."""
    return _decided(spark, d).select("lang", "doc_id", "disposition", "label")


@query(_DECIDED + " SELECT lang, count(*) AS candidates, count_if(disposition = 'kept')::BIGINT AS kept, count_if(disposition = 'duplicate')::BIGINT AS dropped, count_if(disposition = 'conflict')::BIGINT AS conflicts FROM s GROUP BY lang")
def evidence_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Kept and dropped candidates per context."""
    return evidence.evidence_counts(_decided(spark, d), ["lang"])


_TOKENS = """
WITH p AS (SELECT conv_id, turn, text, generate_subscripts(string_split(text, ' '), 1) AS i, unnest(string_split(text, ' ')) AS w FROM conversations),
o AS (SELECT conv_id, turn, w, coalesce(sum(length(w) + 1) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM p),
c AS (SELECT conv_id, turn, CASE WHEN pos < 40 THEN 'related' WHEN pos >= 100 AND pos < 160 THEN 'unrelated' ELSE 'unreviewed' END AS category FROM o WHERE trim(w, chr(32)) <> '')"""


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    messages = table(spark, d, "conversations").select("conv_id", "turn", F.col("text"))
    words = evidence.word_offsets(messages, ["conv_id", "turn"], "text")
    spans = messages.select("conv_id", "turn", F.explode(F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(c).alias("category")) for a, b, c in ((0, 40, "related"), (100, 160, "unrelated"))])).alias("s")).select("conv_id", "turn", "s.*")
    return evidence.tokens_by_category(words, spans, ["conv_id", "turn"], ["related", "unrelated", "unreviewed"], "unreviewed")


@query(_TOKENS + " SELECT g.conv_id, g.turn, g.category, count(c.category) AS tokens FROM (SELECT DISTINCT conv_id, turn, unnest(['related', 'unrelated', 'unreviewed']) AS category FROM c) g LEFT JOIN c ON g.conv_id = c.conv_id AND g.turn = c.turn AND g.category = c.category GROUP BY ALL")
def span_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Words assigned to the span that holds their start."""
    return _tokens(spark, d)


@query(_TOKENS + """, r AS (SELECT conv_id, turn, count(*) AS context_tokens, count_if(category = 'unrelated') AS unrelated, conv_id % 4 = 0 AS conservative, conv_id % 5 = 0 AS uncertain, conv_id % 7 = 0 AS reasons FROM c GROUP BY ALL),
s AS (SELECT *, CASE WHEN context_tokens = 0 THEN 'empty_context' WHEN conservative THEN 'lower_bound' WHEN uncertain THEN 'uncertain' WHEN reasons THEN 'unreviewed' ELSE 'reviewed' END AS noise_status FROM r)
SELECT 'all' AS arm, count(*) AS saved_cases, 1000000 - count(*) AS missing_cases, count_if(noise_status = 'reviewed')::BIGINT AS reviewed_cases, count_if(noise_status = 'lower_bound')::BIGINT AS lower_bound_cases, count_if(noise_status = 'uncertain')::BIGINT AS uncertain_cases, count_if(noise_status = 'unreviewed')::BIGINT AS unreviewed_cases,
  sum(context_tokens) FILTER (noise_status = 'reviewed')::BIGINT AS context_tokens, sum(unrelated) FILTER (noise_status = 'reviewed')::BIGINT AS unrelated_text_tokens, round((sum(unrelated) FILTER (noise_status = 'reviewed'))::DOUBLE / (sum(context_tokens) FILTER (noise_status = 'reviewed')), 9) AS noise_ratio FROM s""")
def noise_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Token-weighted noise over reviewed contexts only."""
    per = _tokens(spark, d).groupBy("conv_id", "turn").agg(F.sum("tokens").alias("context_tokens"), F.sum(F.when(F.col("category") == "unrelated", F.col("tokens"))).alias("unrelated_text_tokens"))
    rows = per.withColumn("noise_status", evidence.noise_status(F.col("context_tokens"), F.col("conv_id") % 4 == 0, F.col("conv_id") % 5 == 0, F.col("conv_id") % 7 == 0, F.lit("full"))).withColumn("tokenizer", F.lit("words")).withColumn("arm", F.lit("all"))
    return evidence.aggregate_noise(rows, ["arm"], 1_000_000, ["reviewed", "lower_bound", "uncertain", "unreviewed"]).withColumn("noise_ratio", F.round("noise_ratio", 9))
