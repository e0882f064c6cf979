"""Scalar functions over the tables' texts and timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.functions import exact, text
from proofmill.plans.registry import query, table


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, value, CASE WHEN event_id % 3 = 0 THEN NULL ELSE round(value * 100)::DOUBLE END AS cents FROM events")
def json_props_parse(spark: SparkSession, d: str) -> DataFrame:
    """Typed values out of JSON text; what is no number is null."""
    rows = table(spark, d, "events").withColumn("p", F.from_json("props", "k long"))
    bad = F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.round(F.col("value") * 100).cast("long").cast("string"))
    return rows.select("event_id", F.col("p.k").alias("k"), "value", exact.lenient_decimal(bad).cast("double").alias("cents"))


@query("""
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE epoch_us(date_trunc('minute', ts))::DOUBLE END AS us FROM events""")
def timestamp_parse(spark: SparkSession, d: str) -> DataFrame:
    """Timestamps whose weekday has to be their date's."""
    ts = F.col("ts").cast("timestamp")
    day = F.when(F.col("event_id") % 5 == 0, F.date_format(F.date_add(ts, 1), "EEE")).otherwise(F.date_format(ts, "EEE"))
    written = F.concat(F.date_format(ts, "yyyy/MM/dd ("), day, F.date_format(ts, ") HH:mm"))
    return table(spark, d, "events").select("event_id", F.unix_micros(text.session_timestamp(written)).cast("double").alias("us"))


@query("SELECT o_orderkey, epoch_us(o_orderdate)::BIGINT AS us FROM orders")
def date_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Dates in five written forms."""
    ts, k = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey") % 5
    form = lambda f: F.date_format(ts, f)
    written = F.when(k == 0, form("MMMM-d-yyyy")).when(k == 1, form("MMM d, yyyy")).when(k == 2, form("yyyy_MM_dd")).when(k == 3, form("d MMMM yyyy")).otherwise(form("d MMM yyyy"))
    return table(spark, d, "orders").select("o_orderkey", F.unix_micros(text.date_anchor(written)).alias("us"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS stamp, regexp_replace((epoch_us(ts)::DECIMAL(28,0) / 1000000)::DECIMAL(38,6)::VARCHAR, '\\.?0+$', '') AS seconds FROM events")
def evidence_timestamps(spark: SparkSession, d: str) -> DataFrame:
    """Canonical timestamps from text with an offset, and seconds as decimal text."""
    ts = F.col("ts").cast("timestamp")
    written = F.concat(F.date_format(ts + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+02:00"))
    return table(spark, d, "events").select("event_id", text.evidence_timestamp(written).alias("stamp"), text.seconds_text(F.unix_micros(ts)).alias("seconds"))


@query(r"SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_discount = 0 THEN '0' ELSE regexp_replace(l_discount::DECIMAL(10,4)::VARCHAR, '\.?0+$', '') END AS discount, (l_quantity::BIGINT // 2)::VARCHAR || CASE WHEN l_quantity::BIGINT % 2 = 1 THEN '.5' ELSE '' END AS half FROM lineitem")
def canonical_decimals(spark: SparkSession, d: str) -> DataFrame:
    """Decimal text without trailing zeros, and halves."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", exact.canonical_decimal(F.col("l_discount").cast("decimal(10,4)")).alias("discount"), exact.half_integer_text(F.col("l_quantity").cast("long")).alias("half"))


@query("SELECT doc_id, len(regexp_extract_all(text, '\\S+'))::BIGINT AS tokens FROM documents")
def whitespace_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Words of a text."""
    return table(spark, d, "documents").select("doc_id", text.whitespace_tokens(F.col("text")).alias("tokens"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN NULL WHEN turn % 2 = 0 THEN 'yes' ELSE 'no' END AS verdict FROM conversations")
def yes_no_parse(spark: SparkSession, d: str) -> DataFrame:
    """Yes or no in either case between blanks, else nothing."""
    said = F.when(F.col("turn") % 3 == 0, "yes, surely").when(F.col("turn") % 2 == 0, " YES\n").otherwise("\tNo ")
    parsed = text.yes_no(said)
    return table(spark, d, "conversations").select("conv_id", "turn", F.when(parsed, "yes").when(~parsed, "no").alias("verdict"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN substr(text, 1, 20) END AS answer FROM conversations")
def answer_parse(spark: SparkSession, d: str) -> DataFrame:
    """C11: answers from JSON of exactly two keys."""
    part = F.substring("text", 1, 20)
    written = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.lit("r").alias("reasoning"), part.alias("answer")))).otherwise(F.to_json(F.struct(part.alias("answer"))))
    return table(spark, d, "conversations").select("conv_id", "turn", text.answer_text(written).alias("answer"))


@query("""
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '[March 1 | Turn ' || turn || '] ' ELSE '[Turn ' || turn || '] ' END || upper(substr(role, 1, 1)) || substr(role, 2) || ': ' || text AS line FROM conversations""")
def turn_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """Labelled turns."""
    anchor = F.when(F.col("turn") % 2 == 0, "March 1").otherwise("")
    return table(spark, d, "conversations").select("conv_id", "turn", text.turn_prefix(anchor, F.col("turn").cast("string"), F.col("role"), F.col("text")).alias("line"))


@query("SELECT conv_id, turn, CASE WHEN turn = 3 THEN 'abstention' WHEN role = 'user' THEN 'question' WHEN role = 'assistant' THEN 'reply' END AS template FROM conversations")
def judge_templates(spark: SparkSession, d: str) -> DataFrame:
    """The template by type, abstentions apart."""
    qid = F.concat(F.col("conv_id").cast("string"), F.when(F.col("turn") == 3, "_abs").otherwise(""))
    return table(spark, d, "conversations").select("conv_id", "turn", text.judge_template(F.col("role"), qid, {"user": "question", "assistant": "reply"}, "abstention").alias("template"))


@query("SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(lower(text), '\\bthe\\b') THEN 'article' END, CASE WHEN regexp_matches(lower(text), 'licen[cs]e') THEN 'license' END) AS mentioned FROM documents")
def mentioned_names(spark: SparkSession, d: str) -> DataFrame:
    """Which names a text mentions."""
    return table(spark, d, "documents").select("doc_id", F.array_join(text.mentioned(F.col("text"), {"article": r"\bthe\b", "license": "licen[cs]e"}), ",").alias("mentioned"))


@query("""
SELECT source, (floor((2 * count_if(lang = 'en') * 1000 + count(*))::DECIMAL(38,0) / (2 * count(*)))::BIGINT / 10.0)::DECIMAL(20,1)::VARCHAR || '%' AS rate FROM documents GROUP BY source""")
def rate_text(spark: SparkSession, d: str) -> DataFrame:
    """Rates in percent, half up, as text."""
    c = table(spark, d, "documents").groupBy("source").agg(F.count_if(F.col("lang") == "en").alias("k"), F.count("*").alias("n"))
    return c.select("source", text.percent_text(F.col("k"), F.col("n")).alias("rate"))


@query("SELECT page_id, rtrim(replace(replace(base64(encode(url)), '+', '-'), '/', '_'), '=') AS cursor, url FROM pages")
def cursor_codec(spark: SparkSession, d: str) -> DataFrame:
    """Cursors encode and decode."""
    cursor = text.cursor_encode(F.col("url"))
    return table(spark, d, "pages").select("page_id", cursor.alias("cursor"), text.cursor_decode(cursor).alias("url"))


@query("SELECT page_id, regexp_extract(rtrim(url, '/'), '([^/]*)$', 1) AS name FROM pages")
def path_names(spark: SparkSession, d: str) -> DataFrame:
    """F16: the last part of a URI."""
    return table(spark, d, "pages").select("page_id", text.path_name(F.col("url")).alias("name"))


@query("""
WITH b AS (SELECT doc_id, text, list_filter(range(0, 65), lambda k: octet_length(encode(substr(text, 1, k))) <= 64) AS ks FROM documents) SELECT doc_id, substr(text, 1, list_max(ks)) AS shown, octet_length(encode(text))::BIGINT AS total_bytes, sha256(text) AS digest FROM b""")
def bounded_previews(spark: SparkSession, d: str) -> DataFrame:
    """Previews of 64 bytes that split no character, with the digest of the whole."""
    return table(spark, d, "documents").select("doc_id", text.preview(F.col("text"), 64).alias("shown"), F.octet_length("text").cast("long").alias("total_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query("SELECT event_id, '{\"b\":' || user_id || ',\"é\":\"' || event_type || '\"}' AS canonical FROM events")
def canonical_json(spark: SparkSession, d: str) -> DataFrame:
    """C21 §1.4: canonical JSON of arbitrary maps."""
    written = F.concat(F.lit('{ "é" : "'), F.col("event_type"), F.lit('", "b": '), F.col("user_id").cast("string"), F.lit(" }"))
    return table(spark, d, "events").select("event_id", text.canonical_json(written).alias("canonical"))


@query("SELECT doc_id, sha256('[\"document\",\"' || lang || '\",\"' || source || '\",\"' || doc_id || '\"]') AS identity FROM documents")
def identities(spark: SparkSession, d: str) -> DataFrame:
    """Identity hashes over canonical arrays."""
    return table(spark, d, "documents").select("doc_id", text.identity("document", F.col("lang"), F.col("source"), F.col("doc_id").cast("string")).alias("identity"))


@query("SELECT event_id, '[1, \"' || event_type || '\"]' AS parsed FROM events")
def literal_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Python literals where JSON fails."""
    written = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("[1, '"), F.col("event_type"), F.lit("']"))).otherwise(F.concat(F.lit('[1, "'), F.col("event_type"), F.lit('"]')))
    return table(spark, d, "events").select("event_id", text.literal_json(written).alias("parsed"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'type ' || event_type || ' by {{user}}' END AS rendered FROM events")
def templates(spark: SparkSession, d: str) -> DataFrame:
    """Variables in one pass; a value that looks like a variable stays as it is."""
    template = F.when(F.col("event_id") % 2 == 0, "type {{type}} by {{who}}").otherwise("type {{type}}")
    values = F.to_json(F.struct(F.col("event_type").alias("type"), F.lit("{{user}}").alias("who")))
    return table(spark, d, "events").select("event_id", text.render_template(template, values).alias("rendered"))


@query("""
SELECT l_orderkey, l_partkey, l_linenumber, l_quantity::BIGINT AS input_tokens, (CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_suppkey % 10 END)::DOUBLE AS cached_tokens, CASE WHEN l_linenumber % 3 = 0 THEN 'cached' ELSE '' END AS unavailable FROM lineitem""")
def usage_normalisation(spark: SparkSession, d: str) -> DataFrame:
    """Cached tokens from the nested detail, else from the alias, else unavailable."""
    nested = F.when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit('"prompt_tokens_details": {"cached_tokens": '), (F.col("l_suppkey") % 10).cast("string"), F.lit("}, "))).when(
        F.col("l_linenumber") % 3 == 2, F.concat(F.lit('"prompt_cache_hit_tokens": '), (F.col("l_suppkey") % 10).cast("string"), F.lit(", "))
    ).otherwise("")
    body = F.concat(F.lit("{"), nested, F.lit('"prompt_tokens": '), F.col("l_quantity").cast("long").cast("string"), F.lit("}"))
    u = F.from_json(body, "prompt_tokens long, prompt_cache_hit_tokens long, prompt_tokens_details struct<cached_tokens: long>")
    rows = table(spark, d, "lineitem").withColumn("u", u)
    cached = F.coalesce("u.prompt_tokens_details.cached_tokens", "u.prompt_cache_hit_tokens")
    return rows.select("l_orderkey", "l_partkey", "l_linenumber", F.col("u.prompt_tokens").alias("input_tokens"), cached.cast("double").alias("cached_tokens"), F.array_join(F.array_compact(F.array(F.when(cached.isNull(), "cached"))), ",").alias("unavailable"))


@query("SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN NULL WHEN turn % 4 = 2 THEN role || ',' || conv_id ELSE role END AS memories FROM conversations")
def extracted_memories(spark: SparkSession, d: str) -> DataFrame:
    """Memories as text, object or list; blank ones void the whole."""
    k, quoted = F.col("turn") % 4, F.concat(F.lit('"'), F.col("role"), F.lit('"'))
    written = F.when(k == 0, quoted).when(k == 1, F.concat(F.lit('{"score": 1, "text": '), quoted, F.lit("}"))).when(k == 2, F.concat(F.lit("["), quoted, F.lit(', {"text": "'), F.col("conv_id").cast("string"), F.lit('"}]'))).otherwise(F.concat(F.lit("["), quoted, F.lit(', {"text": " "}]')))
    found = text.extracted_memories(written)
    return table(spark, d, "conversations").select("conv_id", "turn", F.when(found.isNotNull(), F.array_join(F.transform(found, lambda m: m["text"]), ",")).alias("memories"))


@query("SELECT o_orderkey, o_orderkey % 3 <> 0 AS matches FROM orders")
def entity_match(spark: SparkSession, d: str) -> DataFrame:
    """Names in any order against their ambiguous join; every third has one name too many."""
    names = F.array(F.lit("Rome, Italy"), F.col("o_orderstatus"), F.lit("Rome"), F.col("o_orderpriority"))
    joined = F.concat_ws(", ", F.lit("Rome"), F.col("o_orderpriority"), F.lit("Rome, Italy"), F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 3 == 0, "x"))
    return table(spark, d, "orders").select("o_orderkey", text.names_match(names, joined).alias("matches"))


@query("SELECT event_id, event_type IN ('click', 'view') AS listed FROM events WHERE event_type IN ('click', 'view') OR event_id % 10 = 0")
def hit_inventory(spark: SparkSession, d: str) -> DataFrame:
    """hits inside an inventory, unique and with finite scores; others are violations."""
    inventory = spark.createDataFrame([("click",), ("view",)], "kind string")
    rows = table(spark, d, "events").join(F.broadcast(inventory), F.col("event_type") == F.col("kind"), "left")
    return rows.where(F.col("kind").isNotNull() | (F.col("event_id") % 10 == 0)).where(~F.isnan("value")).select("event_id", F.col("kind").isNotNull().alias("listed"))


@query("""
SELECT event_id, CASE event_type WHEN 'view' THEN value WHEN 'click' THEN event_id WHEN 'error' THEN user_id WHEN 'purchase' THEN round(value * 2, 2) END::DOUBLE AS found FROM events""")
def nested_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The first number at any depth under a key that contains an accepted name; texts and other keys do not count."""
    kind, v = F.col("event_type"), F.col("value")
    inner = F.struct(F.when(kind == "purchase", F.round(v * 2, 2)).alias("input_tokens"), F.lit("tokens\\\": 5").alias("note"))
    body = F.to_json(F.struct(
        F.col("event_type").alias("kind"), F.when(kind == "signup", F.lit("12")).alias("tokens"), F.when(kind == "view", v).alias("total_tokens"), F.array(F.struct(F.when(kind == "click", F.col("event_id")).alias("tokens_used"), F.when(kind == "error", F.col("user_id")).alias("mytokens"))).alias("list"), inner.alias("deep"),
    ))
    return table(spark, d, "events").select("event_id", text.first_number(body, ["tokens"]).alias("found"))
