"""Chat formatting by quotation linking (DataFrame operations only).

Lines that begin with ">" are quoted, one level for each mark. The sentences of quoted passages are normalised and
hashed, and joined to the messages of the same conversation that say them. A message answers the message from which
most sentences of its shallowest linked quotation come, long ones before short ones. Messages stand by the path of turns from the root of their
thread; their texts keep no quotations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofmill.llm.common import text_or_empty
from proofmill.session import stored

QUOTE = r"^(?:[ \t]*>)+"
#: A line that only announces a quotation.
ATTRIBUTION = r"(?i)^[ \x09-\x0D]*on .{1,200} wrote:[ \x09-\x0D]*$"
#: Normalised sentences of this length outrank shorter ones in the votes for a parent. ORACLE leaves shorter ones out.
LEAST_CHARS = 8

_PASSAGES = "array<struct<level:int,text:string>>"


def passages(text: Column) -> Column:
    """The runs of lines of one quote level, in order: array of (level, text)."""
    lines = F.transform(
        F.split(text, r"\r?\n", -1),
        lambda line: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(line, QUOTE, 0), "[^>]", "")).cast("int").alias("level"), F.regexp_replace(line, QUOTE + " ?", "").alias("text")
        ),
    )

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(last["level"].alias("level"), F.concat(last["text"], F.lit("\n"), x["text"]).alias("text"))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["level"] == x["level"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(lines, F.array().cast(_PASSAGES), step)


def body(found: Column) -> Column:
    """What a message itself says: its unquoted runs without lines that announce quotations."""
    own = F.array_join(F.transform(F.filter(found, lambda p: p["level"] == 0), lambda p: p["text"]), "\n")
    kept = F.array_join(F.filter(F.split(own, "\n", -1), lambda line: ~line.rlike(ATTRIBUTION)), "\n")
    return F.regexp_replace(F.regexp_replace(kept, r"\n{3,}", "\n\n"), r"^[ \x09-\x0D]+|[ \x09-\x0D]+$", "")


def sentences(text: Column) -> Column:
    """A text's normalised sentences that are not empty: array of (hash, sentence, whether long)."""
    plain = F.transform(F.split(F.regexp_replace(text, r"[ \x09-\x0D]+", " "), r"(?<=[.!?]) ", -1), lambda s: F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]+", " ")))
    return F.transform(F.filter(plain, lambda s: s != ""), lambda s: F.struct(F.xxhash64(s).alias("hash"), s.alias("sentence"), (F.length(s) >= LEAST_CHARS).cast("int").alias("long")))


def reply_links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, parent): for messages with a quotation, the earlier turn that they answer.

    ``messages`` has conv_id, turn and _passages. Of turns that say a sentence, the last before the quotation counts.
    """
    quoting = messages.where(F.exists("_passages", lambda p: p["level"] > 0))
    quoted = quoting.select("conv_id", "turn", F.explode(F.filter("_passages", lambda p: p["level"] > 0)).alias("_p")).select("conv_id", "turn", F.col("_p.level").alias("level"), F.explode(sentences(F.col("_p.text"))).alias("_s")).select("conv_id", "turn", "level", "_s.*")
    quoted = stored(quoted, "quoted")
    # the hash decides where rows go, the sentences themselves whether they meet
    asked = quoted.select(F.col("conv_id").alias("_c"), F.col("hash").alias("_h"), F.col("sentence").alias("_s")).distinct()
    own = messages.join(asked.select("_c").distinct(), F.col("conv_id") == F.col("_c"), "left_semi")
    said = own.select("conv_id", "turn", F.explode(F.array_distinct(sentences(body(F.col("_passages"))))).alias("_s")).select("conv_id", "turn", "_s.hash", "_s.sentence")
    said = said.join(asked, (F.col("conv_id") == F.col("_c")) & (F.col("hash") == F.col("_h")) & (F.col("sentence") == F.col("_s")), "left_semi").distinct()
    # an as-of join by one pass over both sides: linear in the rows of a sentence, however common
    both = said.select("conv_id", "hash", "sentence", "turn", F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("long"), F.col("turn").alias("said")).union(
        quoted.select("conv_id", "hash", "sentence", "turn", "level", "long", F.lit(None).cast(said.schema["turn"].dataType))
    )
    earlier = Window.partitionBy("conv_id", "hash", "sentence").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    source = both.withColumn("parent", F.max("said").over(earlier)).where("level is not null and parent is not null")
    votes = source.groupBy("conv_id", "turn", "level", "parent").agg(F.sum("long").alias("long"), F.count("*").alias("count"))
    best = votes.groupBy("conv_id", "turn").agg(F.min(F.struct("level", (-F.col("long")).alias("l"), (-F.col("count")).alias("n"), (-F.col("parent")).alias("p"))).alias("b"))
    return best.select("conv_id", "turn", (-F.col("b.p")).alias("parent"))


def thread_paths(links: DataFrame) -> DataFrame:
    """(conv_id, turn, path) for linked messages: the turns from the thread's root to the message.

    Each round doubles the stretch of a path, so a chain of n replies takes log2(n) rounds.
    """
    state = stored(links.select("conv_id", "turn", F.col("parent").alias("up"), F.array("turn").alias("path")), "paths")
    while state.where("up is not null").limit(1).count():
        above = state.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        joined = state.join(above, (F.col("conv_id") == F.col("_c")) & (F.col("up") == F.col("_t")), "left")
        path = F.when(F.col("up").isNull(), F.col("path")).when(F.col("_t").isNull(), F.concat(F.array("up"), "path")).otherwise(F.concat("_path", "path"))
        state = stored(joined.select("conv_id", "turn", F.col("_up").alias("up"), path.alias("path")), "paths")
    return state.select("conv_id", "turn", "path")


def format_chat(conversations: DataFrame) -> DataFrame:
    """One row for each message: conv_id, turn, role, content, quote_depth, parent_turn, root_turn, path.

    Rows ordered by (conv_id, path) are the conversations in reply order; messages that answer nothing known are roots
    and stand by their turn. Null and empty texts have empty content. Null conversation ids and turns are linked with
    nothing. Rows that repeat a turn are all kept, share what they are linked with, and are both possible sources. An
    empty table gives no rows. Other columns are ignored.
    """
    messages = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), passages(text_or_empty()).alias("_passages"))
    links = stored(reply_links(messages), "reply-links")
    paths = thread_paths(links)
    known = paths.join(links, ["conv_id", "turn"]).select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("parent").alias("parent_turn"), F.col("path").alias("_path"))
    joined = messages.join(known, (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t")), "left")
    path = F.coalesce("_path", F.array("turn"))
    return joined.select(
        "conv_id", "turn", "role", body(F.col("_passages")).alias("content"), F.coalesce(F.array_max(F.transform("_passages", lambda p: p["level"])), F.lit(0)).cast("int").alias("quote_depth"),
        "parent_turn", F.element_at(path, 1).alias("root_turn"), path.alias("path"),
    )


def chat_rows(conversations: DataFrame) -> DataFrame:
    """``format_chat`` with plain columns: the path as text, and -1 for no parent."""
    return format_chat(conversations).select(
        "conv_id", "turn", "role", "content", "quote_depth", F.coalesce("parent_turn", F.lit(-1).cast("long")).alias("parent_turn"), "root_turn",
        F.array_join(F.transform("path", lambda t: t.cast("string")), "/").alias("path"),
    )


ORACLE = rf"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
l AS (SELECT r, conv_id, turn, generate_subscripts(regexp_split_to_array(text, '\r?\n'), 1) AS pos, unnest(regexp_split_to_array(text, '\r?\n')) AS line FROM m),
v AS (SELECT r, conv_id, turn, pos, length(regexp_replace(regexp_extract(line, '{QUOTE}'), '[^>]', '', 'g')) AS level, regexp_replace(line, '{QUOTE} ?', '') AS body FROM l),
i AS (SELECT *, pos - row_number() OVER (PARTITION BY r, level ORDER BY pos) AS run FROM v),
p AS (SELECT r, conv_id, turn, level, min(pos) AS pos, string_agg(body, chr(10) ORDER BY pos) AS body FROM i GROUP BY r, conv_id, turn, level, run),
o AS (SELECT r, conv_id, turn, regexp_replace(regexp_replace(coalesce(string_agg(body, chr(10) ORDER BY pos) FILTER (level = 0 AND NOT regexp_matches(body, '{ATTRIBUTION}')), ''), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[ \x09-\x0D]+|[ \x09-\x0D]+$', '', 'g') AS body, max(level) AS depth FROM v GROUP BY r, conv_id, turn),
q AS (SELECT conv_id, turn, level, body FROM p WHERE level > 0),
s AS (SELECT conv_id, turn, level, trim(regexp_replace(lower(unnest(string_split(regexp_replace(regexp_replace(body, '[ \x09-\x0D]+', ' ', 'g'), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)))), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS t
      FROM (SELECT conv_id, turn, level, body FROM q UNION ALL SELECT conv_id, turn, 0, body FROM o)),
k AS (SELECT * FROM s WHERE length(t) >= {LEAST_CHARS}),
c AS (SELECT a.conv_id, a.turn, a.level, max(b.turn) AS parent FROM (SELECT row_number() OVER () AS n, * FROM k WHERE level > 0) a JOIN (SELECT DISTINCT conv_id, turn, t FROM k WHERE level = 0) b ON a.conv_id = b.conv_id AND a.t = b.t AND b.turn < a.turn GROUP BY a.n, a.conv_id, a.turn, a.level),
w AS (SELECT conv_id, turn, level, parent, count(*) AS n FROM c GROUP BY ALL),
b AS (SELECT conv_id, turn, parent FROM w QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, n DESC, parent DESC) = 1),
h AS (SELECT conv_id, turn, parent AS up, parent || '/' || turn AS path FROM b UNION ALL SELECT h.conv_id, h.turn, b.parent, b.parent || '/' || h.path FROM h JOIN b ON h.conv_id = b.conv_id AND h.up = b.turn),
f AS (SELECT conv_id, turn, arg_min(path, up) AS path FROM h GROUP BY conv_id, turn)
SELECT m.conv_id, m.turn, m.role, o.body AS content, o.depth::INT AS quote_depth, coalesce(b.parent, -1)::BIGINT AS parent_turn, CASE WHEN f.path IS NULL THEN m.turn ELSE split_part(f.path, '/', 1)::BIGINT END AS root_turn, coalesce(f.path, m.turn::VARCHAR) AS path
FROM m JOIN o ON m.r = o.r LEFT JOIN b ON m.conv_id = b.conv_id AND m.turn = b.turn LEFT JOIN f ON m.conv_id = f.conv_id AND m.turn = f.turn
"""
