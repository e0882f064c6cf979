"""Documents of a report and the rules about them: cells, cases, display text, spans, hits, histories and retrievals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofmill.functions.exact import canonical_decimal, half_up
from proofmill.operators.ledger import all_issues, issues


def number_text(value: Column) -> Column:
    """Four significant digits, half up, with k, M or B from 9999.5, a million and a billion on; tiny values as a bound."""
    v = value.cast("decimal(38,9)")
    size = F.abs(v)
    scaled = F.when(size >= 10**9, v / 10**9).when(size >= 10**6, v / 10**6).when(size >= F.lit("9999.5").cast("decimal(38,9)"), v / 1000).otherwise(v).cast("decimal(38,15)")
    suffix = F.when(size >= 10**9, " B").when(size >= 10**6, " M").when(size >= F.lit("9999.5").cast("decimal(38,9)"), " k").otherwise("")
    whole = F.abs(scaled)
    rounded = [canonical_decimal(F.round(scaled, places)) for places in (0, 1, 2, 3)]
    text = F.when(whole < 10, rounded[3]).when(whole < 100, rounded[2]).when(whole < 1000, rounded[1]).otherwise(rounded[0])
    tiny = (size > 0) & (size < F.lit("0.001").cast("decimal(38,9)"))
    return F.when(tiny, F.when(v > 0, "<0.001").otherwise(">-0.001")).otherwise(F.concat(text, suffix))


def accuracy_text(numerator: Column, denominator: Column, judged: Column, cases: Column) -> Column:
    """"57/60 (95.0%)", with the coverage where not all cases are judged; unavailable without a denominator."""
    coverage = F.concat(F.lit("judged "), judged.cast("string"), F.lit("/"), cases.cast("string"), F.lit(" cases"))
    percent = F.concat(numerator.cast("string"), F.lit("/"), denominator.cast("string"), F.lit(" ("), half_up(numerator * 100, denominator, 1).cast("string"), F.lit("%)"))
    known = numerator.isNotNull() & (denominator > 0)
    closed = (judged >= 0) & (cases >= judged)
    shown = F.when(F.coalesce(known, F.lit(False)), F.concat(percent, F.when(judged < cases, F.concat(F.lit("; "), coverage)).otherwise(""))).otherwise(F.concat(F.lit("unavailable; "), coverage))
    return F.when(F.coalesce(closed, F.lit(False)), shown).otherwise("unavailable")


def rubric_item(category: Column, criterion: Column) -> Column:
    """A criterion as a judge reads it: criteria of event ordering without "should" ask for a mention."""
    return F.when((category == "event_ordering") & ~F.contains(F.lower(criterion), F.lit("should")), F.concat(F.lit("LLM response should mention: "), criterion)).otherwise(criterion)


def first_reference(fields: dict[str, Column]) -> Column:
    """The first of the fields that is not null, as text; an empty text without any."""
    return F.coalesce(*[c.cast("string") for c in fields.values()], F.lit(""))


def splits_character(text: Column, offset: Column) -> Column:
    """Whether a byte offset is inside a character: the byte there continues one."""
    byte = F.hex(F.substring(F.encode(text, "UTF-8"), offset + 1, F.lit(1)))
    return (byte >= "80") & (byte <= "BF")


def span_issues(spans: DataFrame, key: list[str], text: str, categories: list[str]) -> DataFrame:
    """(key, start, code) for reviewed spans (start, end, category, reason) that are no span of the text's UTF-8 bytes:
    ``bounds``, ``category``, ``reason`` (missing where the category needs one) or ``boundary`` (splits a character)."""
    size = F.octet_length(F.encode(text, "UTF-8"))
    ok = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= size)
    needs = ~F.col("category").isin("format", "unreviewed")
    code = (
        F.when(~F.coalesce(ok, F.lit(False)), "bounds").when(~F.coalesce(F.col("category").isin(*categories), F.lit(False)), "category")
        .when(needs & (F.trim(F.coalesce("reason", F.lit(""))) == ""), "reason").when(splits_character(F.col(text), F.col("start")) | splits_character(F.col(text), F.col("end")), "boundary")
    )
    return spans.select(*key, "start", code.alias("code")).where("code is not null")


def result_states(manifest: DataFrame, judged: DataFrame, unjudged: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """key, state, numerator, denominator, reason: each case of the manifest from the union of terminal results.

    judged: numerator, denominator. unjudged and failed: reason. A case without a result is ``pending``; one with
    several is an error when it is read.
    """
    none = F.lit(None)
    parts = [
        judged.select(key, F.lit("judged").alias("state"), F.col("numerator").cast("long"), F.col("denominator").cast("long"), none.cast("string").alias("reason")),
        unjudged.select(key, F.lit("unjudged").alias("state"), none.cast("long").alias("numerator"), none.cast("long").alias("denominator"), F.col("reason").cast("string")),
        failed.select(key, F.lit("answer_failed").alias("state"), none.cast("long").alias("numerator"), none.cast("long").alias("denominator"), F.col("reason").cast("string")),
    ]
    found = all_issues(*parts).groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"), F.first(F.struct("state", "numerator", "denominator", "reason")).alias("_r"))
    joined = manifest.select(key).distinct().join(found, F.col(key) == F.col("_k"), "left")
    state = F.when(F.col("_n") > 1, F.raise_error(F.lit("a case has several results")).cast("string")).otherwise(F.coalesce("_r.state", F.lit("pending")))
    return joined.select(key, state.alias("state"), "_r.numerator", "_r.denominator", "_r.reason")


def hit_issues(hits: DataFrame, inventory: DataFrame) -> DataFrame:
    """(uri, level, code) for search hits (uri, level, score) against the expected uris of each level: ``level`` (none of
    0, 1, 2), ``score`` (null, infinite or no number), ``duplicate`` and ``unknown``."""
    known = inventory.select(F.col("uri").alias("_u"), F.col("level").alias("_l")).distinct()
    counted = hits.groupBy("uri", "level").agg(F.count("*").alias("_n"), F.bool_or(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))).alias("_bad"))
    joined = counted.join(known, F.col("uri").eqNullSafe(F.col("_u")) & F.col("level").eqNullSafe(F.col("_l")), "left")
    code = F.when(~F.coalesce(F.col("level").isin(0, 1, 2), F.lit(False)), "level").when(F.col("_bad"), "score").when(F.col("_n") > 1, "duplicate").when(F.col("_u").isNull(), "unknown")
    return joined.select("uri", "level", code.alias("code")).where("code is not null")


def plan_attempts(plans: DataFrame, attempts: DataFrame, plan: str, parent: str) -> DataFrame:
    """Each plan with its attempts' number, first start and last end, plans without attempts included."""
    sums = attempts.groupBy(F.col(parent).alias("_p")).agg(F.count("*").alias("attempts"), F.min("started").alias("first_start"), F.max("ended").alias("last_end"))
    return plans.join(sums, F.col(plan) == F.col("_p"), "left").select(*plans.columns, F.coalesce("attempts", F.lit(0)).alias("attempts"), "first_start", "last_end")


def usage_projection(attempts: DataFrame, usage: DataFrame, key: str, dimensions: list[str]) -> DataFrame:
    """Attempts with the sums of their usage records' dimensions, how many measured each, and a status."""
    sums = usage.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("records"), *[F.sum(d).alias(d) for d in dimensions], *[F.count(d).alias(f"_n_{d}") for d in dimensions])
    measured = reduce(Column.__add__, [F.col(f"_n_{d}") for d in dimensions])
    status = F.when(F.coalesce(measured, F.lit(0)) == 0, "unavailable").when(measured < len(dimensions) * F.col("records"), "measured_partial").otherwise("measured_complete")
    return attempts.join(sums, F.col(key) == F.col("_k"), "left").select(*attempts.columns, F.coalesce("records", F.lit(0)).alias("records"), *dimensions, status.alias("status"))


def covered_mean(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Sum, mean to one decimal (half up) and coverage of a value that not every row has."""
    sums = rows.groupBy(*by).agg(F.count("*").alias("cases"), F.count(value).alias("measured"), F.sum(value).alias("total"))
    status = F.when(F.col("measured") == 0, "unavailable").when(F.col("measured") < F.col("cases"), "measured_partial").otherwise("measured_complete")
    return sums.select(*by, "cases", "measured", "total", half_up(F.col("total"), F.col("measured"), 1).alias("mean"), status.alias("status"))


def ordered_distinct(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """Each value once per group, where it stands first, numbered in that order."""
    first = rows.groupBy(*by, value).agg(F.min(order).alias("first"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("first", value)))


def winner(numerator: Column, left: Column, right: Column) -> Column:
    """Whom a signed delta favours; null for none and for no delta."""
    return F.when(numerator > 0, left).when(numerator < 0, right)


def cell_documents(cases: DataFrame, by: list[str]) -> DataFrame:
    """One row per arm: judged and correct cases, context total and mean, and the median and 95th percentile of time.

    cases: ok (boolean or null), context (long or null), micros (long or null).
    """
    sums = cases.groupBy(*by).agg(
        F.count("*").alias("cases"), F.count("ok").alias("judged"), F.count_if("ok").alias("correct"), F.sum("context").alias("context_total"), F.count("context").alias("context_n"),
        F.expr("percentile(micros, 0.5)").alias("median_us"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY micros)").alias("p95_us"),
    )
    text = accuracy_text(F.col("correct"), F.col("judged"), F.col("judged"), F.col("cases"))
    return sums.select(*by, "cases", "judged", "correct", text.alias("accuracy"), "context_total", half_up(F.col("context_total"), F.col("context_n"), 1).alias("context_mean"), "median_us", "p95_us")


def analysis_input(cells: DataFrame, evidence: DataFrame, key: str, arm: str) -> DataFrame:
    """One row per question: its evidence per arm as an array in the arms' order, beside each arm's cell.

    As many entries as there are arms; the evidence of a question that an arm lacks is null.
    """
    # a row per arm reaches the driver, a handful; it comes back as a constant, so no question meets another's arms
    shown = cells.select(F.struct(F.col(arm).alias("arm"), F.struct(*[c for c in cells.columns if c != arm]).alias("cell")).alias("c")).orderBy("c.arm")
    listed = [r[0] for r in shown.select(F.to_json("c", {"ignoreNullFields": "false"})).collect()]
    arms = F.from_json(F.lit(f"[{','.join(listed)}]"), f"array<{shown.schema['c'].dataType.simpleString()}>")
    fields = F.struct(*[c for c in evidence.columns if c not in (key, arm)])
    have = evidence.where(F.col(arm).isNotNull()).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col(arm), fields))).alias("_have"))
    return have.select(key, F.transform(arms, lambda a: F.struct(a["arm"].alias("arm"), a["cell"].alias("cell"), F.try_element_at("_have", a["arm"]).alias("evidence"))).alias("arms"))


def raw_reference_issues(references: DataFrame, payloads: DataFrame, ref: str, content: str) -> DataFrame:
    """References without a payload of that id (``missing``), and payloads that do not hash to their id (``hash``)."""
    p = payloads.select(F.col(ref).alias("_id"), F.sha2(F.col(content).cast("binary"), 256).alias("_sha"))
    asked = references.where(F.col(ref).isNotNull()).select(ref).distinct()
    return all_issues(issues("missing", asked.join(p, F.col(ref) == F.col("_id"), "left_anti"), ref), issues("hash", p.where(~F.col("_id").eqNullSafe(F.col("_sha"))), "_id"))


def history_issues(plans: DataFrame, history: DataFrame, operations: DataFrame) -> DataFrame:
    """History closure: each plan has one chain of attempts, ordinals from 1 on, exactly one of them ready and it is the
    last, and every operation that an attempt names is of its plan.

    plans: plan_id. history: plan_id, attempt_id, ordinal, ready, operations (array). operations: operation_id, plan_id.
    """
    w = Window.partitionBy("plan_id").orderBy("ordinal")
    rows = history.withColumn("_row", F.row_number().over(w)).withColumn("_last", F.lead("ordinal").over(w).isNull())
    sums = rows.groupBy(F.col("plan_id").alias("_p")).agg(
        F.bool_or(F.col("ordinal") != F.col("_row")).alias("o"), (F.count_if("ready") != 1).alias("r"), F.bool_or(F.col("ready") & ~F.col("_last")).alias("l")
    )
    joined = plans.select("plan_id").distinct().join(sums, F.col("plan_id") == F.col("_p"), "full_outer")
    named = history.select(F.col("plan_id").alias("_plan"), F.explode("operations").alias("_o")).join(operations.select(F.col("operation_id").alias("_id"), F.col("plan_id").alias("_of")), F.col("_o") == F.col("_id"), "left")
    return all_issues(
        issues("no_chain", joined.where("_p is null"), "plan_id"), issues("unknown_plan", joined.where("plan_id is null"), "_p"), issues("ordinals", joined.where("o"), "_p"), issues("ready", joined.where("r"), "_p"),
        issues("ready_not_last", joined.where("l"), "_p"), issues("operation", named.where(~F.col("_of").eqNullSafe(F.col("_plan"))), "_o"),
    )


def retrieval_issues(cases: DataFrame, items: DataFrame) -> DataFrame:
    """Retrieved items against what their case says: ``ids`` (the items' ids in rank order are not the case's array),
    ``hashes`` (neither their contents' digests), ``parent`` (an item of another plan) and ``case`` (of no case).

    cases: case_id, plan_id, item_ids, content_hashes (arrays). items: case_id, plan_id, rank, item_id, content. A case's
    items are as many as it retrieved.
    """
    made = items.groupBy(F.col("case_id").alias("_c")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "item_id", F.sha2(F.col("content").cast("binary"), 256).alias("sha")))).alias("_items"), F.collect_set("plan_id").alias("_plans")
    )
    joined = cases.join(made, F.col("case_id") == F.col("_c"), "full_outer")
    got = lambda name: F.coalesce(F.transform("_items", lambda x: x[name]), F.array())
    both = F.col("case_id").isNotNull()
    return all_issues(
        issues("case", joined.where("case_id is null"), "_c"), issues("ids", joined.where(both & ~got("item_id").cast("array<string>").eqNullSafe(F.col("item_ids").cast("array<string>"))), "case_id"),
        issues("hashes", joined.where(both & ~got("sha").eqNullSafe(F.col("content_hashes"))), "case_id"), issues("parent", joined.where(both & F.exists("_plans", lambda p: ~p.eqNullSafe(F.col("plan_id")))), "case_id"),
    )


def visible_context(decisions: DataFrame, separator: str = "\n\n") -> DataFrame:
    """Each case's context made again from its decision ledger: text, SHA-256, bytes, kept, dropped and truncated.

    decisions: case_id, rank, disposition (kept, truncated or dropped), content, taken (characters of a truncated one).
    """
    shown = F.when(F.col("disposition") == "kept", F.col("content")).when(F.col("disposition") == "truncated", F.substring(F.col("content"), F.lit(1), F.col("taken").cast("int")))
    count = lambda name: F.count_if(F.col("disposition") == name).alias(name)
    sums = decisions.groupBy("case_id").agg(F.array_sort(F.collect_list(F.when(shown.isNotNull(), F.struct("rank", shown.alias("text"))))).alias("_parts"), count("kept"), count("truncated"), count("dropped"))
    text = F.array_join(F.transform("_parts", lambda p: p["text"]), separator)
    return sums.select("case_id", text.alias("context"), F.sha2(text.cast("binary"), 256).alias("sha256"), F.octet_length(text).cast("long").alias("bytes"), "kept", "truncated", "dropped")


def context_issues(said: DataFrame, decisions: DataFrame) -> DataFrame:
    """Cases whose saved context (sha256, bytes, kept, truncated, dropped) is not what the ledger gives."""
    made = visible_context(decisions).select(F.col("case_id").alias("_c"), *[F.col(c).alias(f"_{c}") for c in ("sha256", "bytes", "kept", "truncated", "dropped")])
    joined = said.join(made, F.col("case_id") == F.col("_c"), "left")
    found = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in ("sha256", "bytes", "kept", "truncated", "dropped")]))
    return joined.select(F.explode(found).alias("code"), F.col("case_id").cast("string").alias("ref"))


def denominator_issues(members: DataFrame, frame: DataFrame, by: str, key: str, expected: dict[str, int]) -> DataFrame:
    """A selection against its frame: ``member`` for a key that the frame lacks, ``denominator`` for a stratum without
    the expected number of members, and ``stratum`` for a member that the frame puts elsewhere."""
    f = frame.select(F.col(key).alias("_k"), F.col(by).alias("_by"))
    joined = members.join(f, F.col(key) == F.col("_k"), "left")
    wanted = members.sparkSession.createDataFrame(list(expected.items()), "_s string, _n long")
    counts = F.broadcast(wanted).join(members.groupBy(F.col(by).alias("_b")).agg(F.count_distinct(key).alias("_got")), F.col("_s") == F.col("_b"), "left")
    return all_issues(
        issues("member", joined.where("_k is null"), key), issues("stratum", joined.where(F.col("_k").isNotNull() & ~F.col(by).eqNullSafe(F.col("_by"))), key),
        issues("denominator", counts.where(F.coalesce("_got", F.lit(0)) != F.col("_n")), "_s"),
    )


def occurrence_issues(occurrences: DataFrame, inventory: DataFrame, records: DataFrame) -> DataFrame:
    """Occurrences whose saved units differ from the inventory's in content or order (``inventory``), and records that
    name a parent of another occurrence (``parent``).

    occurrences: occurrence_id, unit_ids (array). inventory: occurrence_id, ordinal, unit_id. records: record_id,
    occurrence_id, parent_id; a parent belongs to the occurrence of the inventory that has it as a unit.
    """
    made = inventory.groupBy(F.col("occurrence_id").alias("_o")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "unit_id"))), lambda x: x["unit_id"]).alias("_units"))
    joined = occurrences.join(made, F.col("occurrence_id") == F.col("_o"), "full_outer")
    owner = inventory.select(F.col("unit_id").alias("_u"), F.col("occurrence_id").alias("_of"))
    owned = records.join(owner, F.col("parent_id") == F.col("_u"), "left")
    return all_issues(
        issues("inventory", joined.where(~F.col("unit_ids").eqNullSafe(F.col("_units"))), F.coalesce("occurrence_id", "_o")), issues("parent", owned.where(~F.col("occurrence_id").eqNullSafe(F.col("_of"))), "record_id")
    )


def metric_issues(cases: DataFrame, judges: DataFrame) -> DataFrame:
    """Case metrics (case_id, state, numerator, denominator) against the trace of judge attempts (case_id, ordinal, outcome,
    verdict): ``not_null`` (a metric where the case did not run or is unjudged), ``judge`` (a judged case whose last
    attempt is not its one success) and ``fraction`` (another fraction than the last verdict gives)."""
    w = Window.partitionBy("case_id").orderBy("ordinal")
    traced = judges.withColumn("_last", F.lead("ordinal").over(w).isNull()).groupBy(F.col("case_id").alias("_c")).agg(
        F.count_if(F.col("outcome") == "succeeded").alias("_n"), F.max(F.when(F.col("_last"), F.col("outcome"))).alias("_outcome"), F.max(F.when(F.col("_last"), F.col("verdict").cast("int"))).alias("_verdict")
    )
    joined = cases.join(traced, F.col("case_id") == F.col("_c"), "left")
    judged = F.col("state") == "judged"
    final = (F.coalesce("_n", F.lit(0)) == 1) & F.col("_outcome").eqNullSafe(F.lit("succeeded"))
    code = (
        F.when(~judged & (F.col("numerator").isNotNull() | F.col("denominator").isNotNull()), "not_null").when(judged & ~final, "judge")
        .when(judged & ~(F.col("numerator").cast("int").eqNullSafe(F.col("_verdict")) & F.col("denominator").eqNullSafe(F.lit(1))), "fraction")
    )
    return joined.select(code.alias("code"), F.col("case_id").cast("string").alias("ref")).where("code is not null")


#: Characters that change the direction of text, have no width, or control a terminal.
HIDDEN = r"[\u200b-\u200f\u202a-\u202e\u2060-\u2069\ufeff\x00-\x08\x0b\x0c\x0e-\x1f]"


def export_issues(files: DataFrame, payload: DataFrame, most_bytes: int, forbidden: str) -> DataFrame:
    """Exported files (path, content) against the payload (path, sha256) that a report names: ``missing``, ``extra``,
    ``changed``, ``size`` (over the cap), ``hidden`` (characters that turn or hide text) and ``secret`` (a forbidden pattern)."""
    f = files.select("path", F.octet_length(F.encode("content", "UTF-8")).alias("_n"), F.sha2(F.col("content").cast("binary"), 256).alias("_sha"), F.col("content").rlike(HIDDEN).alias("_hidden"), F.col("content").rlike(forbidden).alias("_secret"))
    p = payload.select(F.col("path").alias("_p"), F.col("sha256").alias("_said"))
    both = f.join(p, F.col("path") == F.col("_p"), "full_outer")
    there = F.col("path").isNotNull()
    checks = {
        "missing": ~there, "extra": F.col("_p").isNull(), "changed": there & F.col("_p").isNotNull() & ~F.col("_sha").eqNullSafe(F.col("_said")), "size": there & (F.col("_n") > most_bytes), "hidden": there & F.col("_hidden"), "secret": there & F.col("_secret"),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]))
    return both.select(F.explode(found).alias("code"), F.coalesce("path", "_p").cast("string").alias("ref"))


def usage_cover_issues(plans: DataFrame, usage: DataFrame, attempts: DataFrame) -> DataFrame:
    """A plan's usage ids (plan_id, usage_ids) against the usage records (usage_id, plan_id, attempt_id), both ways, and
    whether the records cover all attempts (attempt_id, plan_id): ``unknown``, ``unlisted``, ``repeated``, ``uncovered``."""
    listed = plans.select("plan_id", F.explode("usage_ids").alias("usage_id"))
    u = usage.select(F.col("usage_id").alias("_u"), F.col("plan_id").alias("_p"))
    both = listed.distinct().join(u.distinct(), (F.col("usage_id") == F.col("_u")) & (F.col("plan_id") == F.col("_p")), "full_outer")
    used = usage.select(F.col("attempt_id").alias("_a"), F.col("plan_id").alias("_ap")).distinct()
    bare = attempts.join(used, (F.col("attempt_id") == F.col("_a")) & (F.col("plan_id") == F.col("_ap")), "left_anti")
    return all_issues(
        issues("unknown", both.where("_u is null"), "usage_id"), issues("unlisted", both.where("usage_id is null"), "_u"), issues("repeated", listed.groupBy("usage_id").count().where("count > 1"), "usage_id"), issues("uncovered", bare, "attempt_id")
    )


def reduction_differences(stored: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a stored reduction that a fresh one does not give, and the other way round: key, side, and the row's values
    as text. Rows count as often as they are there."""
    values = [c for c in stored.columns if c not in key]
    signed = stored.withColumn("_n", F.lit(1)).unionByName(fresh.select(*stored.columns).withColumn("_n", F.lit(-1)))
    found = signed.groupBy(*stored.columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    shown = F.concat_ws("|", *[F.coalesce(F.col(v).cast("string"), F.lit("")) for v in values])
    return found.select(*key, F.when(F.col("_n") > 0, "stored").otherwise("fresh").alias("side"), shown.alias("row"))


def review_worksheet(contexts: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """The rows that a reviewer still has to fill: contexts without a review, in a stable order, with empty columns."""
    todo = contexts.join(reviews.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_anti")
    return todo.select("*", F.lit("").alias("category"), F.lit("").alias("reason"))


def review_summary(contexts: DataFrame, reviews: DataFrame, key: str, by: list[str], categories: list[str]) -> DataFrame:
    """Reviewed, open and unknown rows per group after a worksheet came back, and how many have each category.

    A review of a context that is not there, or a second one of a context, is an error when it is read.
    """
    r = reviews.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"), F.min("category").alias("_category"))
    joined = contexts.join(r, F.col(key) == F.col("_k"), "full_outer")
    bad = F.col(key).isNull() | (F.col("_n") > 1)
    checked = joined.withColumn("_category", F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("a review is unknown or repeated")).cast("string")).otherwise(F.col("_category")))
    return checked.groupBy(*by).agg(F.count("*").alias("contexts"), F.count("_category").alias("reviewed"), *[F.count_if(F.col("_category") == c).alias(c) for c in categories])
