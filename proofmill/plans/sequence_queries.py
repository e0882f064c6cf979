"""Ordered operators over events, orders and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.operators import packing, sequence
from proofmill.plans.registry import query, table

_BY, _ORDER = ["user_id"], ["ts", "event_id"]


@query("""
WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_type <> 'error' THEN value END AS v FROM events),
o AS (SELECT *, row_number() OVER w AS ord FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
f AS (SELECT event_id, v, first_value(CASE WHEN v IS NOT NULL THEN ord END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nx,
  last_value(CASE WHEN v IS NOT NULL THEN ord END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pv,
  first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pvv FROM o)
SELECT event_id, coalesce(nv, pvv) AS filled, coalesce(nx, pv)::DOUBLE AS donor FROM f""")
def donor_fill(spark: SparkSession, d: str) -> DataFrame:
    """A missing value comes from the next row that has one, else from the last before."""
    rows = table(spark, d, "events").withColumn("v", F.when(F.col("event_type") != "error", F.col("value")))
    rows = sequence.ordinals(rows, _BY, _ORDER)
    return sequence.donor_fill(rows, _BY, _ORDER, "v", "ordinal").select("event_id", "filled", F.col("donor").cast("double").alias("donor"))


_ISLANDS = """
WITH c AS (SELECT user_id, event_type, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS ch, ts, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT user_id, event_type, sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM c),
r AS (SELECT user_id, island::BIGINT AS island, min(event_type) AS event_type, count(*) AS length FROM i GROUP BY user_id, island)"""


@query(_ISLANDS + " SELECT user_id, island, event_type, length FROM r")
def retry_islands(spark: SparkSession, d: str) -> DataFrame:
    """Runs of equal values."""
    return sequence.islands(table(spark, d, "events"), _BY, _ORDER, "event_type")


@query(_ISLANDS + " SELECT user_id, sum(ceil(length / 2.0))::BIGINT AS outer_attempts, count(*) > count(DISTINCT event_type) AS reappeared FROM r GROUP BY user_id")
def outer_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Attempts with one transport retry each collapsed."""
    return sequence.outer_attempts(sequence.islands(table(spark, d, "events"), _BY, _ORDER, "event_type"), _BY, "event_type", 1)


_SPANS = "SELECT l_orderkey AS ctx, l_partkey AS a, l_partkey + l_quantity::BIGINT AS b, l_linenumber, l_suppkey FROM lineitem"


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("ctx"), F.col("l_partkey").alias("a"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("b"))


@query(f"SELECT ctx, a, b, nx AS next_start FROM (SELECT ctx, a, b, lead(a) OVER (PARTITION BY ctx ORDER BY a, b) AS nx FROM ({_SPANS})) WHERE nx < b")
def span_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Spans that reach into the next one."""
    return sequence.overlaps(_spans(spark, d), ["ctx"], "a", "b")


@query(f"""
WITH u AS (SELECT ctx, a, max(b) AS b FROM ({_SPANS}) GROUP BY ctx, a), n AS (SELECT ctx, lag(b, 1, 0) OVER (PARTITION BY ctx ORDER BY a) AS gap_start, a AS gap_end FROM u), t AS (SELECT ctx, max(b) AS gap_start, 2100 AS gap_end FROM u GROUP BY ctx)
SELECT * FROM (SELECT * FROM n UNION ALL SELECT * FROM t) WHERE gap_start < gap_end""")
def span_gaps(spark: SparkSession, d: str) -> DataFrame:
    """What lies between the spans of a context."""
    rows = _spans(spark, d).groupBy("ctx", "a").agg(F.max("b").alias("b")).withColumn("whole", F.lit(2100).cast("long"))
    return sequence.gaps(rows, ["ctx"], "a", "b", "whole")


@query("SELECT conv_id, turn, coalesce(sum(octet_length(encode(text))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM conversations")
def running_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Byte offsets of the messages of a conversation."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.octet_length("text").alias("n"))
    return sequence.running_offset(rows, ["conv_id"], ["turn"], "n").select("conv_id", "turn", F.col("offset").cast("long").alias("offset"))


@query("SELECT count(*) AS rows, count_if(l_suppkey <= l_partkey AND l_partkey <= l_orderkey)::BIGINT AS monotonic FROM lineitem")
def monotonic_clocks(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose clocks never go back."""
    return table(spark, d, "lineitem").agg(F.count("*").alias("rows"), F.count_if(sequence.monotonic(["l_suppkey", "l_partkey", "l_orderkey"])).alias("monotonic"))


@query("SELECT DISTINCT l_linenumber::BIGINT AS n, CASE WHEN l_linenumber <= 3 THEN [5, 15, 30][l_linenumber] ELSE 30 * (1::BIGINT << (l_linenumber - 3)) END::BIGINT AS wait FROM lineitem")
def backoff_table(spark: SparkSession, d: str) -> DataFrame:
    """Waits by retry ordinal."""
    return table(spark, d, "lineitem").select(F.col("l_linenumber").cast("long").alias("n")).distinct().withColumn("wait", sequence.backoff_seconds(F.col("n"), [5, 15, 30]))


@query("""
WITH c AS (SELECT user_id, event_id, row_number() OVER w AS seq, md5(event_id::VARCHAR) AS h, CASE WHEN event_id % 97 = 0 THEN 'x' ELSE lag(md5(event_id::VARCHAR)) OVER w END AS pred FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, seq::BIGINT AS seq FROM c WHERE event_id % 97 = 0""")
def chain_breaks(spark: SparkSession, d: str) -> DataFrame:
    """Checkpoints that do not follow the one before."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    h = F.md5(F.col("event_id").cast("string").cast("binary"))
    rows = table(spark, d, "events").withColumn("seq", F.row_number().over(w)).withColumn("h", h)
    rows = rows.withColumn("pred", F.when(F.col("event_id") % 97 == 0, "x").otherwise(F.lag("h").over(w)))
    return sequence.chain_breaks(rows, ["user_id"], "seq", "h", "pred").select("user_id", "event_id", F.col("seq").cast("long").alias("seq"))


@query("""
WITH t AS (SELECT * FROM (VALUES ('signup', 1), ('view', 1), ('click', 1), ('purchase', 1)) v(s, one)),
e AS (SELECT e.event_id, e.user_id, e.ts, e.event_type, lag(t.s) OVER w AS came, row_number() OVER w AS n, t.s IS NULL AS illegal FROM events e LEFT JOIN t ON e.event_type = t.s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN illegal THEN 'illegal' ELSE 'discontinuous' END AS violation FROM e WHERE illegal OR (n > 1 AND came IS DISTINCT FROM event_type)""")
def invalid_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Events that the transition table does not allow; each state stays itself here."""
    steps = spark.createDataFrame([(s, s, s) for s in ("signup", "view", "click", "purchase")], "from_state string, on_event string, to_state string")
    rows = table(spark, d, "events").withColumn("state", F.col("event_type"))
    return sequence.invalid_transitions(rows, ["user_id"], _ORDER, "state", "event_type", steps).select("event_id", "violation")


@query("""
WITH f AS (SELECT source, doc_id, lang, n_chars, row_number() OVER (PARTITION BY source, md5(text) ORDER BY doc_id) AS k FROM documents),
u AS (SELECT *, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM f WHERE k = 1)
SELECT source, doc_id, least(n_chars, greatest(20000 - used, 0))::BIGINT AS shown FROM u WHERE least(n_chars, greatest(20000 - used, 0)) > 0""")
def budgeted_previews(spark: SparkSession, d: str) -> DataFrame:
    """Each text once, until a budget is used up; the one that crosses it is shortened."""
    rows = table(spark, d, "documents").withColumn("ref", F.md5(F.col("text").cast("binary")))
    return sequence.budgeted(rows, ["source"], ["doc_id"], "ref", "n_chars", 20000).select("source", "doc_id", F.col("shown").cast("long").alias("shown"))


@query("""
SELECT o_orderkey, sum(round(o_totalprice * 100)::BIGINT) OVER w ::BIGINT AS running, sum(round(o_totalprice * 100)::BIGINT) OVER w <= 100000000 AS fits FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)""")
def budget_running_total(spark: SparkSession, d: str) -> DataFrame:
    """A ledger replayed against a ceiling."""
    rows = table(spark, d, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    return sequence.running_total(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], "cents", 100_000_000).select("o_orderkey", "running", "fits")


@query("""
WITH RECURSIVE m AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, turn, length(text) AS n FROM conversations),
c AS (SELECT conv_id, k, turn, n, 0::BIGINT AS chunk, n AS len FROM m WHERE k = 1 UNION ALL
      SELECT m.conv_id, m.k, m.turn, m.n, CASE WHEN c.len + 2 + m.n > 1500 THEN c.chunk + 1 ELSE c.chunk END, CASE WHEN c.len + 2 + m.n > 1500 THEN m.n ELSE c.len + 2 + m.n END FROM c JOIN m ON m.conv_id = c.conv_id AND m.k = c.k + 1)
SELECT conv_id, chunk, turn, n::BIGINT AS chars FROM c""")
def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Messages joined into chunks of bounded length."""
    return packing.chunk_documents(table(spark, d, "conversations"), "conv_id", "turn", "text", 1500)


@query()
def message_packing(spark: SparkSession, d: str) -> DataFrame:
    """Batches of at most 3 pieces and 600 bytes, long messages split between characters."""
    return packing.pack_messages(table(spark, d, "conversations"), "conv_id", "turn", "text", 3, 600)
