"""Conversation histories from JSON, under explicit schemas.

Files are read as text and parsed in the plan, so that the position in the file is a column and a row that does not
fit its schema becomes a violation instead of a silent null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.functions.text import date_anchor, session_timestamp, turn_prefix
from proofmill.operators.sequence import donor_fill

MESSAGE = "struct<role:string,content:string,has_answer:boolean>"
ROW = f"struct<question_id:string,question_type:string,question:string,answer:string,question_date:string,answer_session_ids:array<string>,haystack_session_ids:array<string>,haystack_dates:array<string>,haystack_sessions:array<array<{MESSAGE}>>>"
TURN = "struct<id:string,role:string,content:string,time_anchor:string>"


def checked_text(spark: SparkSession, path: str, sha256: str | None = None) -> DataFrame:
    """Whole files as text; with a checksum, a file that has another one is an error before anything is parsed."""
    files = spark.read.format("binaryFile").load(path).select("path", "content", F.sha2("content", 256).alias("sha256"))
    if sha256 is not None:
        files = files.withColumn("content", F.when(F.col("sha256") == sha256, F.col("content")).otherwise(F.raise_error(F.lit("checksum mismatch")).cast("binary")))
    return files.select("path", "sha256", F.decode("content", "UTF-8").alias("value"))


def read_rows(spark: SparkSession, path: str, sha256: str | None = None) -> DataFrame:
    """Questions with their sessions: one row per element of a top-level array, with a 1-based ordinal. A file whose top
    level is no array is an error.

    ``sessions`` is sorted by time and by place; ``violations`` names what is wrong with a row. Answers keep their JSON text.
    """
    text = checked_text(spark, path, sha256)
    listed = F.when(F.col("value").rlike(r"^\s*\["), F.col("value")).otherwise(F.raise_error(F.lit("the top level is no array")))
    raw = text.withColumn("value", listed).select(F.posexplode(F.from_json("value", f"array<{ROW}>")).alias("pos", "r"))
    rows = raw.select((F.col("pos") + 1).alias("ordinal"), "r.*")
    n = F.size("haystack_session_ids")
    sessions = F.transform(
        F.arrays_zip("haystack_session_ids", "haystack_dates", "haystack_sessions"),
        lambda s, i: F.struct(session_timestamp(s["haystack_dates"]).alias("ts"), i.alias("place"), s["haystack_session_ids"].alias("session_id"), s["haystack_sessions"].alias("messages")),
    )
    rows = rows.withColumn("question_ts", session_timestamp(F.col("question_date"))).withColumn("sessions", F.array_sort(sessions))
    bad = {
        "unaligned": (F.size("haystack_dates") != n) | (F.size("haystack_sessions") != n) | (n < 1),
        "question_date": F.col("question_ts").isNull(),
        "session_date": F.exists("sessions", lambda s: s["ts"].isNull()),
        "role": F.exists("sessions", lambda s: F.exists(s["messages"], lambda m: ~F.coalesce(m["role"].isin("user", "assistant"), F.lit(False)) | m["content"].isNull())),
        "question_id": F.coalesce(F.col("question_id"), F.lit("")) == "",
        "unresolved_answer": F.size(F.array_except("answer_session_ids", "haystack_session_ids")) > 0,
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(True)), F.lit(name)) for name, cond in bad.items()]))
    flagged = rows.withColumn("violations", found).withColumn("after_question", F.transform("sessions", lambda s: s["ts"] > F.col("question_ts")))
    return flagged.drop("haystack_session_ids", "haystack_dates", "haystack_sessions")


def session_document(messages: Column) -> Column:
    """Role and content only, as compact JSON: labels do not reach a provider."""
    return F.to_json(F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))))


def duplicate_questions(rows: DataFrame) -> DataFrame:
    return rows.groupBy("question_id").count().where("count > 1")


def read_conversations(spark: SparkSession, path: str, sha256: str | None = None) -> DataFrame:
    """(conversation_id, session, time_anchor, user_info, turns): sessions out of three shapes of nested chats.

    A chat element is a list of turns, one turn, or a map of plans to batches whose turn groups are lists or turns.
    """
    conv = "struct<conversation_id:string,user_profile:struct<user_info:string>,chat:array<string>,probing_questions:string>"
    text = checked_text(spark, path, sha256)
    listed = F.when(F.col("value").rlike(r"^\s*\["), F.col("value")).otherwise(F.raise_error(F.lit("the top level is no array")))
    raw = text.withColumn("value", listed).select(F.posexplode(F.from_json("value", f"array<{conv}>")).alias("history", "c"))
    parts = raw.select("history", F.col("c.conversation_id").alias("conversation_id"), F.col("c.user_profile.user_info").alias("user_info"), F.posexplode("c.chat").alias("part", "x"))
    batch = "struct<time_anchor:string,turns:array<string>>"
    plans = F.from_json("x", f"map<string,array<{batch}>>")
    turn_list = lambda text: F.when(F.ltrim(text).startswith("["), F.from_json(text, f"array<{TURN}>")).otherwise(F.array(F.from_json(text, TURN)))
    of_map = F.transform(F.flatten(F.map_values(plans)), lambda b: F.struct(b["time_anchor"].alias("time_anchor"), F.flatten(F.transform(b["turns"], turn_list)).alias("turns")))
    single = F.from_json("x", TURN)
    sessions = (
        F.when(F.ltrim("x").startswith("["), F.array(F.struct(F.lit(None).cast("string").alias("time_anchor"), F.from_json("x", f"array<{TURN}>").alias("turns"))))
        .when(F.get_json_object("x", "$.role").isNotNull(), F.array(F.struct(single["time_anchor"].alias("time_anchor"), F.array(single).alias("turns"))))
        .otherwise(of_map)
    )
    each = parts.select("history", "conversation_id", "user_info", "part", F.posexplode(sessions).alias("sub", "s"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("history").orderBy("part", "sub")) - 1
    return each.select("conversation_id", "user_info", "history", place.alias("session"), F.col("s.time_anchor").alias("time_anchor"), F.col("s.turns").alias("turns"))


def dated_sessions(sessions: DataFrame) -> DataFrame:
    """Each session's date: its own, its first dated turn's, else the next dated session's, else the last before."""
    anchor = F.coalesce(F.col("time_anchor"), F.try_element_at(F.filter(F.transform("turns", lambda t: t["time_anchor"]), lambda a: a.isNotNull()), F.lit(1)))
    rows = sessions.withColumn("own_date", date_anchor(anchor))
    return donor_fill(rows, ["history"], ["session"], "own_date", "session").withColumnsRenamed({"filled": "event_time", "donor": "donor_session"})


def session_messages(dated: DataFrame) -> DataFrame:
    """One row per turn with its labelled content and its time."""
    rows = dated.select("conversation_id", "history", "session", "event_time", F.posexplode("turns").alias("place", "t"))
    line = turn_prefix(F.coalesce("t.time_anchor", F.lit("")), F.coalesce("t.id", F.lit("")), F.col("t.role"), F.col("t.content"))
    return rows.select("conversation_id", "history", "session", "place", F.col("t.role").alias("role"), line.alias("content"), F.coalesce(date_anchor(F.col("t.time_anchor")), F.col("event_time")).alias("event_time"))


def keep_selected(histories: DataFrame, questions: str, selection: list[str]) -> DataFrame:
    """Histories with the selected questions only; histories without any go."""
    ids = F.array(*[F.lit(s) for s in selection])
    kept = histories.withColumn(questions, F.filter(questions, lambda q: F.array_contains(ids, q["question_id"])))
    return kept.where(F.size(questions) > 0)


#: The reader of each kind of dataset, the array that holds its sessions or turns, and the column of its identity.
READERS = {"rows": (read_rows, "question_id"), "conversations": (read_conversations, "conversation_id")}


def load_histories(spark: SparkSession, kind: str, path: str, sha256: str | None = None, selection: list[str] | None = None) -> DataFrame:
    """A dataset of one of READERS, behind its checksum, with the selected identities only.

    An unknown kind, a repeated identity in the file and a selected identity that it lacks are errors.
    """
    if kind not in READERS:
        raise ValueError(f"unknown kind of dataset: {kind}")
    reader, key = READERS[kind]
    rows = reader(spark, path, sha256)
    whole = rows if kind == "rows" else rows.select(key, "history").distinct()
    if whole.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError(f"a {key} is there more than once")
    if selection is None:
        return rows
    wanted = spark.createDataFrame([(s,) for s in selection], f"{key} string")
    if wanted.join(whole, key, "left_anti").limit(1).count() or len(set(selection)) != len(selection):
        raise ValueError("the selection names an identity that is unknown or repeated")
    return rows.join(wanted, key, "left_semi")
