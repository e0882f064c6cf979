"""Closure of ledgers: attempts, usage, resources, costs, retries, model calls and saved results.

Rules give rows (code, ref): a code for what does not close and the identity it is about. A rule is one aggregate or
one equi-join over keys, so it scales with the rows and never compares all pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is computed once a row, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def issues(code: str, rows: DataFrame, ref: Column | str) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), (F.col(ref) if isinstance(ref, str) else ref).cast("string").alias("ref"))


def all_issues(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def view_closure(records: DataFrame, views: DataFrame, key: str, owner: str) -> DataFrame:
    """Records against their views, both ways: repeated ids on either side, ids that one side lacks, other owners."""
    side = lambda rows, name: rows.groupBy(F.col(key).alias(f"_{name}")).agg(F.count("*").alias(f"n_{name}"), F.first(owner).alias(f"o_{name}"))
    both = side(records, "record").join(side(views, "view"), F.col("_record") == F.col("_view"), "full_outer")
    code = (
        F.when(F.col("_view").isNull(), "without_view").when(F.col("_record").isNull(), "without_record")
        .when(F.col("n_record") > 1, "duplicate_record").when(F.col("n_view") > 1, "duplicate_view").when(~F.col("o_record").eqNullSafe(F.col("o_view")), "owner_differs")
    )
    return both.select(code.alias("code"), F.coalesce("_record", "_view").cast("string").alias("ref")).where("code is not null")


def ownership_issues(attempts: DataFrame, usage: DataFrame, resources: DataFrame, costs: DataFrame) -> DataFrame:
    """Whether each attempt has one cost that draws on one usage and one resource of its own.

    attempts: attempt_id, parent_id, stage. usage: usage_id, attempt_id. resources: resource_id, parent_id, stage. costs:
    cost_id, parent_id, usage_ids, resource_ids (arrays). Attempts of unknown outcome without evidence are left out by
    the caller. Codes: ``sources`` (a cost without exactly one usage and one resource), ``unknown_source``,
    ``binding`` (parent or stage differ from the attempt's), ``attempt_cost`` and ``resource_cost`` (not exactly one cost).
    """
    one = (F.size("usage_ids") == 1) & (F.size("resource_ids") == 1)
    single = costs.where(one).select("cost_id", F.col("parent_id").alias("_cp"), F.element_at("usage_ids", 1).alias("_u"), F.element_at("resource_ids", 1).alias("_r"))
    u = usage.select(F.col("usage_id").alias("_uid"), F.col("attempt_id").alias("_ua"))
    r = resources.select(F.col("resource_id").alias("_rid"), F.col("parent_id").alias("_rp"), F.col("stage").alias("_rs"))
    a = attempts.select(F.col("attempt_id").alias("_aid"), F.col("parent_id").alias("_ap"), F.col("stage").alias("_as"))
    traced = single.join(u, F.col("_u") == F.col("_uid"), "left").join(r, F.col("_r") == F.col("_rid"), "left").join(a, F.col("_ua") == F.col("_aid"), "left")
    unknown = F.col("_uid").isNull() | F.col("_rid").isNull() | F.col("_aid").isNull()
    differs = ~(F.col("_rp").eqNullSafe(F.col("_ap")) & F.col("_rs").eqNullSafe(F.col("_as")) & F.col("_cp").eqNullSafe(F.col("_ap")))
    good = traced.where(~unknown & ~differs)
    per_attempt = attempts.select("attempt_id").distinct().join(good.groupBy("_aid").count(), F.col("attempt_id") == F.col("_aid"), "left").where(F.coalesce("count", F.lit(0)) != 1)
    per_resource = resources.select("resource_id").distinct().join(good.groupBy("_rid").count(), F.col("resource_id") == F.col("_rid"), "left").where(F.coalesce("count", F.lit(0)) != 1)
    return all_issues(
        issues("sources", costs.where(~one), "cost_id"), issues("unknown_source", traced.where(unknown), "cost_id"), issues("binding", traced.where(~unknown & differs), "cost_id"),
        issues("attempt_cost", per_attempt, "attempt_id"), issues("resource_cost", per_resource, "resource_id"),
    )


def retry_issues(events: DataFrame, backoff: list[int]) -> DataFrame:
    """Retry events (attempt_id, ordinal, scheduled, backoff, call_id) against the schedule.

    Codes: ``ordinals`` (an attempt's ordinals are not 1 to n), ``backoff`` (a scheduled event whose wait is not the
    schedule's, or that has none), ``unscheduled`` (one without a next try that is not the last), ``duplicate_call``.
    """
    w = Window.partitionBy("attempt_id")
    rows = events.withColumn("_n", F.count("*").over(w)).withColumn("_row", F.row_number().over(w.orderBy("ordinal", "call_id")))
    table = F.array(*[F.lit(b).cast("long") for b in backoff])
    wait = F.when((F.col("ordinal") >= 1) & (F.col("ordinal") <= len(backoff)), F.get(table, F.col("ordinal").cast("int") - 1))
    checked = rows.groupBy("attempt_id").agg(
        F.bool_or(F.col("ordinal") != F.col("_row")).alias("o"), F.bool_or(F.col("scheduled") & ~F.coalesce(F.col("backoff").cast("long") == wait, F.lit(False))).alias("b"),
        F.bool_or(~F.col("scheduled") & (F.col("_row") < F.col("_n"))).alias("u"),
    )
    calls = events.groupBy("call_id").count().where("count > 1")
    return all_issues(issues("ordinals", checked.where("o"), "attempt_id"), issues("backoff", checked.where("b"), "attempt_id"), issues("unscheduled", checked.where("u"), "attempt_id"), issues("duplicate_call", calls, "call_id"))


def retry_totals(events: DataFrame, by: list[str], most: int) -> DataFrame:
    """Events, scheduled retries, internal retries, both together, and whether that is within the cap."""
    units = F.sum(F.col("internal") + F.col("scheduled").cast("long"))
    return events.groupBy(*by).agg(F.count("*").alias("events"), F.count_if("scheduled").alias("scheduled"), F.sum("internal").alias("internal"), units.alias("units"), (units <= most).alias("within_cap"))


def chain_issues(attempts: DataFrame, most: int = 18) -> DataFrame:
    """Chains of model attempts (chain_id, ordinal, attempt_id, retry_of, outcome, prompt_sha256, request_sha256).

    Codes, of which a chain can have several: ``length`` (over ``most``), ``first`` (the first retries another),
    ``link`` (one that does not retry the one before), ``predecessor`` (one before the last that did not fail and whose
    outcome is known), ``last`` (the last did not succeed) and ``prompt`` (the first does not send the prompt).
    """
    w = Window.partitionBy("chain_id").orderBy("ordinal")
    rows = attempts.withColumn("_before", F.lag("attempt_id").over(w)).withColumn("_row", F.row_number().over(w)).withColumn("_last", F.lead("attempt_id").over(w).isNull())
    first = F.col("_row") == 1
    checks = {
        "length": F.count("*") > most,
        "first": F.bool_or(first & F.col("retry_of").isNotNull()),
        "link": F.bool_or(~first & ~F.col("retry_of").eqNullSafe(F.col("_before"))),
        "predecessor": F.bool_or(~F.col("_last") & ~F.coalesce(F.col("outcome").isin("failed", "unknown_outcome"), F.lit(False))),
        "last": F.bool_or(F.col("_last") & ~F.col("outcome").eqNullSafe(F.lit("succeeded"))),
        "prompt": F.bool_or(first & ~F.coalesce(F.col("prompt_sha256") == F.col("request_sha256"), F.lit(False))),
    }
    per_chain = rows.groupBy("chain_id").agg(*[check.alias(name) for name, check in checks.items()])
    found = F.array_compact(F.array(*[F.when(F.col(name), F.lit(name)) for name in checks]))
    return per_chain.select(F.explode(found).alias("code"), F.col("chain_id").cast("string").alias("ref"))


def index_contributions(attempts: DataFrame, plans: DataFrame) -> DataFrame:
    """attempts with ``expected``: what an attempt adds to the index.

    ``final`` for a memory_ingest that succeeded and whose plan (parent_id) is sealed, ``none`` for another one of that
    stage, ``not_applicable`` for other stages.
    """
    sealed = plans.where(F.col("state") == "sealed").select(F.col("plan_id").alias("_plan")).distinct()
    joined = attempts.join(sealed, F.col("parent_id") == F.col("_plan"), "left")
    final = (F.col("outcome") == "succeeded") & F.col("_plan").isNotNull()
    return joined.withColumn("expected", F.when(F.col("stage") != "memory_ingest", "not_applicable").when(final, "final").otherwise("none")).drop("_plan")


def contribution_issues(attempts: DataFrame, plans: DataFrame, usage: DataFrame) -> DataFrame:
    """``contribution`` where the recorded contribution is not the expected one, ``usage`` where an attempt's usage records
    (attempt_id) are not as many as it says (expected_usage)."""
    checked = index_contributions(attempts, plans)
    count = usage.groupBy(F.col("attempt_id").alias("_a")).agg(F.count("*").alias("_used"))
    used = attempts.join(count, F.col("attempt_id") == F.col("_a"), "left")
    return all_issues(issues("contribution", checked.where(~F.col("contribution").eqNullSafe(F.col("expected"))), "attempt_id"), issues("usage", used.where(F.coalesce("_used", F.lit(0)) != F.col("expected_usage")), "attempt_id"))


def unproved_results(results: DataFrame, calls: DataFrame, keys: list[str]) -> DataFrame:
    """Results that no model call proves: ``keys`` are stage, content and the identity of the request."""
    proof = calls.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    return results.join(proof, reduce(Column.__and__, [F.col(k) == F.col(f"_{k}") for k in keys]), "left_anti")


_COMPLETION = (
    "choices array<struct<finish_reason:string,message:struct<content:string,refusal:string,tool_calls:array<string>>>>, "
    "usage struct<prompt_tokens:string,completion_tokens:string,total_tokens:string>"
)


def completion(body: Column) -> Column:
    """(content, problem, prompt_tokens, completion_tokens, total_tokens) of a chat completion's JSON.

    ``problem`` is null or the first that holds: ``malformed``, ``truncated`` (finish_reason is not stop), ``refused``,
    ``tool_calls``, ``empty``, ``usage`` (a count that is no integer of 0 or more). With a problem there is no content.
    """
    def parts(x: Column) -> Column:
        c = x["c"]
        choice = F.get(c["choices"], F.lit(0))
        message, usage = choice["message"], c["usage"]
        counts = {k: F.when(usage[k].rlike("^[0-9]{1,18}$"), usage[k].cast("long")) for k in ("prompt_tokens", "completion_tokens", "total_tokens")}
        typed = x["typed"]
        text = F.regexp_replace(message["content"], r"^\s+|\s+$", "")
        problem = (
            F.when(choice.isNull() | message.isNull(), "malformed").when(~choice["finish_reason"].eqNullSafe(F.lit("stop")), "truncated")
            .when(F.coalesce(message["refusal"], F.lit("")) != "", "refused").when(F.coalesce(F.size(message["tool_calls"]), F.lit(0)) > 0, "tool_calls")
            .when(typed.isNull() | (F.coalesce(text, F.lit("")) == ""), "empty").when(reduce(Column.__or__, [v.isNull() for v in counts.values()]), "usage")
        )
        return F.struct(F.when(problem.isNull(), text).alias("content"), problem.alias("problem"), *[F.when(problem.isNull(), v).alias(k) for k, v in counts.items()])

    return bound(F.struct(F.from_json(body, _COMPLETION).alias("c"), F.get_json_object(body, "$.choices[0].message.content").alias("typed")), parts)


#: The dimensions of a usage record, in order; the first three are the base.
DIMENSIONS = ("input_tokens", "visible_output_tokens", "supplier_reported_total_tokens", "cached_input_tokens", "reasoning_tokens")


def upgrade_usage(v2: DataFrame, v3: DataFrame, attempts: DataFrame, key: str) -> DataFrame:
    """One usage record of the newest version for each attempt: key, version, DIMENSIONS, covered, unavailable, proof, reason.

    A version 3 record keeps all its values, a version 2 record has no cached and reasoning tokens, and an attempt
    without a record has every dimension unavailable. Missing columns are nulls, never zeros.
    """
    old = v2.select(F.col(key).alias("_k"), F.lit(2).alias("source_version"), *DIMENSIONS[:3])
    new = v3.select(F.col(key).alias("_k"), F.lit(3).alias("source_version"), *DIMENSIONS)
    known = old.unionByName(new, allowMissingColumns=True)
    joined = attempts.select(key).distinct().join(known, F.col(key) == F.col("_k"), "left")
    pick = lambda there: F.array_compact(F.array(*[F.when(F.col(d).isNotNull() == there, F.lit(d)) for d in DIMENSIONS]))
    covered, unavailable = pick(True), pick(False)
    proof = F.when(F.size(covered) == 0, "unavailable").when(F.size(unavailable) == 0, "measured_complete").otherwise("measured_partial")
    reason = F.when(F.col("source_version").isNull(), "supplier_token_usage_unavailable")
    return joined.select(key, "source_version", *DIMENSIONS, covered.alias("covered"), unavailable.alias("unavailable"), proof.alias("proof_status"), reason.alias("reason"))


_USAGE = (
    "prompt_tokens string, completion_tokens string, total_tokens string, prompt_cache_hit_tokens string, prompt_cache_miss_tokens string, "
    "prompt_tokens_details struct<cached_tokens:string>, completion_tokens_details struct<reasoning_tokens:string>"
)


def usage_details(body: Column) -> Column:
    """Usage of a supplier's JSON: base counts, cached and reasoning tokens, status, limitations and problem.

    Base counts are required integers. Cached tokens come from the nested detail, else from the alias; the aliases come
    as a pair whose sum is the prompt tokens and agree with the detail. A missing detail is unavailable; an unknown field
    is a limitation and makes the record partial. ``problem`` names the first rule that is broken.
    """
    names = ("input_tokens", "visible_output_tokens", "supplier_reported_total_tokens")
    known = ("prompt_tokens", "completion_tokens", "total_tokens", "prompt_tokens_details", "completion_tokens_details", "prompt_cache_hit_tokens", "prompt_cache_miss_tokens")
    count = lambda c: F.when(c.rlike("^[0-9]{1,18}$"), c.cast("long"))

    def counted(x: Column) -> Column:
        u = x["u"]
        return F.struct(
            *[count(u[raw]).alias(name) for name, raw in zip(names, known, strict=False)], count(u["prompt_cache_hit_tokens"]).alias("hit"), count(u["prompt_cache_miss_tokens"]).alias("miss"),
            count(u["prompt_tokens_details"]["cached_tokens"]).alias("nested"), count(u["completion_tokens_details"]["reasoning_tokens"]).alias("reasoning"),
            u["prompt_cache_hit_tokens"].isNotNull().alias("has_hit"), u["prompt_cache_miss_tokens"].isNotNull().alias("has_miss"), F.array_sort(F.filter(x["keys"], lambda k: ~k.isin(*known))).alias("unknown"),
        )

    def judged(n: Column) -> Column:
        problem = (
            F.when(n[names[0]].isNull() | n[names[1]].isNull() | n[names[2]].isNull(), "base").when(n["has_hit"] != n["has_miss"], "alias_pair")
            .when(n["has_hit"] & (n["hit"].isNull() | n["miss"].isNull() | (n["hit"] + n["miss"] != n[names[0]])), "alias_sum").when(n["has_hit"] & n["nested"].isNotNull() & (n["nested"] != n["hit"]), "alias_detail")
        )
        cached = F.coalesce(n["nested"], n["hit"])
        missing = F.array_compact(F.array(F.when(cached.isNull(), "unavailable:cached_input_tokens"), F.when(n["reasoning"].isNull(), "unavailable:reasoning_tokens")))
        limits = F.concat(F.transform(n["unknown"], lambda k: F.concat(F.lit("unknown_field:"), k)), missing)
        return F.struct(n.alias("n"), cached.alias("cached"), problem.alias("problem"), F.array_join(limits, ",").alias("limitations"))

    def shown(j: Column) -> Column:
        whole = j["problem"].isNull()
        proof = F.when(j["limitations"] == "", "measured_complete").otherwise("measured_partial")
        values = {**{name: j["n"][name] for name in names}, "cached_input_tokens": j["cached"], "reasoning_tokens": j["n"]["reasoning"], "proof_status": proof}
        return F.struct(*[F.when(whole, value).alias(name) for name, value in values.items()], j["limitations"].alias("limitations"), j["problem"].alias("problem"))

    parsed = F.struct(F.from_json(body, _USAGE).alias("u"), F.json_object_keys(body).alias("keys"))
    return bound(bound(bound(parsed, counted), judged), shown)


def recall_score(scores: Column) -> Column:
    """(score, problem) of a recall result's scores as JSON: ``final`` is a required number and is kept as its text;
    semantic and keyword are numbers or null; a reranker score or another field is a problem. Null scores give nulls."""
    raw = lambda name: F.get_json_object(scores, f"$.{name}")
    number = lambda name: F.from_json(scores, f"{name} string")[name].rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$") & ~scores.rlike(rf'"{name}"\s*:\s*"')
    extra = F.size(F.array_except(F.json_object_keys(scores), F.array(*[F.lit(n) for n in ("final", "reranker", "semantic", "keyword")]))) > 0
    loose = reduce(Column.__or__, [raw(n).isNotNull() & ~F.coalesce(number(n), F.lit(False)) for n in ("semantic", "keyword")])
    problem = F.when(F.coalesce(extra, F.lit(True)), "fields").when(~F.coalesce(number("final"), F.lit(False)), "final").when(raw("reranker").isNotNull(), "reranker").when(loose, "score")
    return F.when(scores.isNotNull(), F.struct(F.when(problem.isNull(), raw("final")).alias("score"), problem.alias("problem")))


def run_counters(contexts: DataFrame, plans: DataFrame, cases: DataFrame, diagnostic: bool = False) -> DataFrame:
    """One row of a run's counters. contexts: context_id. plans: state. cases: state, disposition, parsed (boolean).

    A diagnostic summary never claims that evaluation was validated: its judged counters are null.
    """
    state, judged = F.col("state"), F.col("disposition")
    ends = ("completed", "error", "unsupported", "cancelled", "budget_exceeded")
    rows = all_issues(
        cases.select(F.lit("case").alias("kind"), F.col("state").cast("string"), F.col("disposition").cast("string"), F.col("parsed").cast("boolean"), F.lit(None).cast("string").alias("context")),
        plans.select(F.lit("plan").alias("kind"), F.col("state").cast("string"), F.lit(None).cast("string").alias("disposition"), F.lit(None).cast("boolean").alias("parsed"), F.lit(None).cast("string").alias("context")),
        contexts.select(F.lit("context").alias("kind"), F.lit(None).cast("string").alias("state"), F.lit(None).cast("string").alias("disposition"), F.lit(None).cast("boolean").alias("parsed"), F.col("context_id").cast("string").alias("context")),
    )
    case = lambda name, holds: F.count_if((F.col("kind") == "case") & holds).alias(name)
    checked = lambda name, holds: F.lit(None).cast("long").alias(name) if diagnostic else case(name, holds)
    return rows.agg(
        case("intended_cases", F.lit(True)), case("terminal_cases", state.isin(*ends)), case("completed_cases", state == "completed"), case("errored_cases", state == "error"), case("unsupported_cases", state == "unsupported"),
        case("cancelled_cases", state == "cancelled"), case("budget_exceeded_cases", state == "budget_exceeded"), checked("parsed_cases", F.col("parsed")), checked("evaluated_cases", judged.isin("deterministic", "judged")),
        checked("judged_cases", judged == "judged"), checked("unjudged_cases", judged == "unjudged"), checked("metric_eligible_cases", (state == "completed") & judged.isin("deterministic", "judged")),
        F.count_if(F.col("kind") == "plan").alias("intended_plans"), F.count_if((F.col("kind") == "plan") & (state == "sealed")).alias("ready_plans"), F.count_distinct("context").alias("intended_contexts"),
    )


def attempt_outcomes(attempts: DataFrame, by: list[str]) -> DataFrame:
    """Attempts by outcome (outcome) and retries (retry_of) per group."""
    count = lambda name: F.count_if(F.col("outcome") == name).alias(name)
    return attempts.groupBy(*by).agg(F.count("*").alias("attempts"), count("succeeded"), count("failed"), count("unknown_outcome"), F.count("retry_of").alias("retries"))


def carried_issues(results: DataFrame, status: str, dataset: str, allowed: list[str]) -> DataFrame:
    """Rows whose ``evaluation_status`` is a carried "No" that it may not be.

    A carried result belongs to ``dataset``, has score 0 and correct false, and none of the fields beyond ``allowed``:
    ``fields`` are the names that the result has, as an array.
    """
    fixed = (F.col("dataset") == dataset) & (F.col("score") == 0) & ~F.col("correct")
    closed = F.size(F.array_except("fields", F.array(*[F.lit(f) for f in allowed]))) == 0
    return results.where((F.col("evaluation_status") == status) & ~F.coalesce(fixed & closed, F.lit(False)))


def constant_drift(rows: DataFrame, key: str, constants: dict[str, Column | str | int], sums: dict[str, str]) -> DataFrame:
    """(code, ref): columns that are not the constants they have to be, and totals that are not the sum of their array."""
    wrong = {name: ~F.col(name).eqNullSafe(value if isinstance(value, Column) else F.lit(value)) for name, value in constants.items()}
    wrong |= {total: ~F.col(total).eqNullSafe(F.aggregate(F.col(parts), F.lit(0).cast("long"), lambda a, x: a + x)) for total, parts in sums.items()}
    found = F.array_compact(F.array(*[F.when(w, F.lit(name)) for name, w in wrong.items()]))
    return rows.select(F.explode(found).alias("code"), F.col(key).cast("string").alias("ref"))


def question_texts(manifest: DataFrame, rows: DataFrame, key: str, ordinal: str, text: str, sha256: str) -> DataFrame:
    """key, ordinal, text, problem: the manifest's questions with their text from the dataset.

    ``problem`` is ``missing`` where the dataset lacks the question, ``duplicate`` where it has several, and ``changed``
    where the text does not hash to the manifest's digest; a question with a problem has no text.
    """
    known = rows.groupBy(F.col(key).alias("_k")).agg(F.min(text).alias("_text"), F.count("*").alias("_n"))
    joined = manifest.join(known, F.col(key) == F.col("_k"), "left")
    problem = F.when(F.col("_k").isNull(), "missing").when(F.col("_n") > 1, "duplicate").when(~F.coalesce(F.sha2(F.col("_text").cast("binary"), 256) == F.col(sha256), F.lit(False)), "changed")
    return joined.select(key, ordinal, F.when(problem.isNull(), F.col("_text")).alias(text), problem.alias("problem"))
