"""Ledger rules on planted and unplanted rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from proofmill.operators import ledger


def codes(df):
    return sorted((r.code, r.ref) for r in df.collect())


def test_ownership(spark):
    attempts = spark.createDataFrame([(i, 7, "s") for i in range(1, 6)], "attempt_id long, parent_id long, stage string")
    usage = spark.createDataFrame([(10 + i, i) for i in range(1, 6)], "usage_id long, attempt_id long")
    resources = spark.createDataFrame([(20 + i, 7, "s" if i != 3 else "t") for i in range(1, 6)], "resource_id long, parent_id long, stage string")
    good = [(30 + i, 7, [10 + i], [20 + i]) for i in range(1, 6)]
    costs = lambda rows: spark.createDataFrame(rows, "cost_id long, parent_id long, usage_ids array<long>, resource_ids array<long>")
    whole = resources.withColumn("stage", F.lit("s"))
    assert codes(ledger.ownership_issues(attempts, usage, whole, costs(good))) == []
    bad = [good[0], (32, 7, [12, 11], [22]), good[2], (34, 7, [99], [24]), good[4], (36, 7, [15], [25])]
    assert codes(ledger.ownership_issues(attempts, usage, resources, costs(bad))) == [
        ("attempt_cost", "2"), ("attempt_cost", "3"), ("attempt_cost", "4"), ("attempt_cost", "5"), ("binding", "33"),
        ("resource_cost", "22"), ("resource_cost", "23"), ("resource_cost", "24"), ("resource_cost", "25"), ("sources", "32"), ("unknown_source", "34"),
    ]


def test_retries(spark):
    schema = "attempt_id long, ordinal long, scheduled boolean, backoff long, call_id string"
    good = [(1, 1, True, 5, "a"), (1, 2, True, 10, "b"), (1, 3, False, None, "c"), (2, 1, True, 5, "d")]
    assert codes(ledger.retry_issues(spark.createDataFrame(good, schema), [5, 10])) == []
    bad = [(1, 1, True, 5, "a"), (1, 3, True, 10, "b"), (2, 1, False, None, "c"), (2, 2, True, 10, "d"), (3, 1, True, 6, "e"), (4, 1, True, 5, "f"), (4, 2, True, 10, "g"), (4, 3, True, None, "f")]
    assert codes(ledger.retry_issues(spark.createDataFrame(bad, schema), [5, 10])) == [("backoff", "1"), ("backoff", "3"), ("backoff", "4"), ("duplicate_call", "f"), ("ordinals", "1"), ("unscheduled", "2")]


def test_model_chains(spark):
    schema = "chain_id long, ordinal long, attempt_id string, retry_of string, outcome string, prompt_sha256 string, request_sha256 string"
    good = [(1, 1, "a", None, "failed", "p", "p"), (1, 2, "b", "a", "unknown_outcome", "p", "q"), (1, 3, "c", "b", "succeeded", "p", "r"), (2, 1, "d", None, "succeeded", "p", "p")]
    assert codes(ledger.chain_issues(spark.createDataFrame(good, schema))) == []
    long = [(3, i, f"x{i}", f"x{i - 1}" if i > 1 else None, "failed" if i < 19 else "succeeded", "p", "p") for i in range(1, 20)]
    bad = [(4, 1, "a", "z", "succeeded", "p", "q"), (4, 2, "b", "z", "failed", "p", "p"), *long]
    assert codes(ledger.chain_issues(spark.createDataFrame(bad, schema))) == [("first", "4"), ("last", "4"), ("length", "3"), ("link", "4"), ("predecessor", "4"), ("prompt", "4")]


def _body(content="yes", finish="stop", usage=(1, 2, 3), **message):
    return json.dumps({"choices": [{"finish_reason": finish, "message": {"content": content, **message}}], "usage": dict(zip(("prompt_tokens", "completion_tokens", "total_tokens"), usage, strict=True))})


@pytest.mark.parametrize(
    ("body", "problem"),
    [
        (_body(" yes "), None), (_body("yes", "length"), "truncated"), (_body("yes", refusal="no"), "refused"), (_body("yes", tool_calls=[{"id": 1}]), "tool_calls"), (_body(" \n"), "empty"), (_body(None), "empty"),
        (_body(usage=(1, "x", 3)), "usage"), (_body(usage=(1, -2, 3)), "usage"), ("{}", "malformed"), ("no json", "malformed"),
    ],
)
def test_completions(spark, body, problem):
    row = spark.createDataFrame([(body,)], "b string").select(ledger.completion(F.col("b")).alias("c")).head().c
    assert (row.problem, row.content, row.total_tokens) == ((None, "yes", 3) if problem is None else (problem, None, None))


def test_usage_details(spark):
    base = {"prompt_tokens": 10, "completion_tokens": 4, "total_tokens": 14}
    cases = [
        ({**base, "prompt_tokens_details": {"cached_tokens": 3}, "completion_tokens_details": {"reasoning_tokens": 0}}, (3, 0, "measured_complete", "", None)),
        ({**base, "prompt_cache_hit_tokens": 6, "prompt_cache_miss_tokens": 4}, (6, None, "measured_partial", "unavailable:reasoning_tokens", None)),
        ({**base, "prompt_cache_hit_tokens": 6}, (None, None, None, "unavailable:reasoning_tokens", "alias_pair")),
        ({**base, "prompt_cache_hit_tokens": 6, "prompt_cache_miss_tokens": 5}, (None, None, None, "unavailable:reasoning_tokens", "alias_sum")),
        ({**base, "prompt_cache_hit_tokens": 6, "prompt_cache_miss_tokens": 4, "prompt_tokens_details": {"cached_tokens": 5}}, (None, None, None, "unavailable:reasoning_tokens", "alias_detail")),
        ({"prompt_tokens": 10, "total_tokens": 14}, (None, None, None, "unavailable:cached_input_tokens,unavailable:reasoning_tokens", "base")),
        ({**base, "surcharge": 1}, (None, None, "measured_partial", "unknown_field:surcharge,unavailable:cached_input_tokens,unavailable:reasoning_tokens", None)),
    ]
    rows = spark.createDataFrame([(i, json.dumps(b)) for i, (b, _) in enumerate(cases)], "i long, b string").select("i", ledger.usage_details(F.col("b")).alias("u")).orderBy("i").collect()
    assert [(r.u.cached_input_tokens, r.u.reasoning_tokens, r.u.proof_status, r.u.limitations, r.u.problem) for r in rows] == [want for _, want in cases]


def test_recall_scores(spark):
    cases = [('{"final": 0.25, "semantic": null, "keyword": 1}', ("0.25", None)), ('{"final": 1, "reranker": 0.5}', (None, "reranker")), ('{"final": "1"}', (None, "final")), ('{"semantic": 1}', (None, "final")), ('{"final": 1, "other": 2}', (None, "fields"))]
    rows = spark.createDataFrame([(i, s) for i, (s, _) in enumerate([*cases, (None, None)])], "i long, s string").select("i", ledger.recall_score(F.col("s")).alias("r")).orderBy("i").collect()
    assert [(r.r.score, r.r.problem) for r in rows[:-1]] == [want for _, want in cases] and rows[-1].r is None


def test_views_close_both_ways(spark):
    r = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (3, "a"), (4, "a")], "id long, owner string")
    v = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (5, "a")], "id long, owner string")
    assert codes(ledger.view_closure(r, v, "id", "owner")) == [("duplicate_record", "3"), ("owner_differs", "2"), ("without_record", "5"), ("without_view", "4")]


def test_diagnostic_counters_claim_no_evaluation(spark):
    contexts, plans = spark.createDataFrame([("c",), ("c",)], "context_id string"), spark.createDataFrame([("sealed",), ("open",)], "state string")
    cases = spark.createDataFrame([("completed", "judged", True), ("error", None, None), ("pending", None, False)], "state string, disposition string, parsed boolean")
    row, loose = ledger.run_counters(contexts, plans, cases).head(), ledger.run_counters(contexts, plans, cases, diagnostic=True).head()
    assert (row.intended_cases, row.terminal_cases, row.judged_cases, row.metric_eligible_cases, row.ready_plans, row.intended_contexts) == (3, 2, 1, 1, 1, 1)
    assert loose.judged_cases is None and loose.parsed_cases is None and loose.completed_cases == 1


def test_hidden_characters_and_sizes(spark):
    from proofmill.operators import documents

    texts = ["plain", "turn‮ed", "zero​width", "bell\x07", "x" * 50, "token=abc"]
    files = spark.createDataFrame(list(enumerate(texts)), "path long, content string")
    payload = files.where("path <> 0").select("path", F.sha2(F.col("content").cast("binary"), 256).alias("sha256")).union(spark.createDataFrame([(9, "x")], "path long, sha256 string"))
    got = codes(documents.export_issues(files, payload, 40, "token="))
    assert got == [("extra", "0"), ("hidden", "1"), ("hidden", "2"), ("hidden", "3"), ("missing", "9"), ("secret", "5"), ("size", "4")]


def test_four_digits(spark):
    from decimal import Decimal

    from proofmill.operators import documents

    cases = {"0": "0", "0.0005": "<0.001", "-0.0005": ">-0.001", "0.12345": "0.123", "1.2345": "1.235", "12.345": "12.35", "123.45": "123.5", "9999.4": "9999", "9999.5": "10 k", "12345": "12.35 k", "1234567": "1.235 M", "-2500000000": "-2.5 B", "1.0": "1"}
    rows = spark.createDataFrame([(k, Decimal(k)) for k in cases], "k string, v decimal(38,9)").select("k", documents.number_text(F.col("v")).alias("t")).collect()
    assert {r.k: r.t for r in rows} == cases


def test_reviews_must_be_known_and_single(spark):
    from proofmill.operators import documents

    contexts = spark.createDataFrame([(1, "a"), (2, "a")], "id long, g string")
    for reviews in ([(1, "x"), (1, "y")], [(3, "x")]):
        with pytest.raises(Exception, match="unknown or repeated"):
            documents.review_summary(contexts, spark.createDataFrame(reviews, "id long, category string"), "id", ["g"], ["x"]).collect()
    open_rows = documents.review_worksheet(contexts, spark.createDataFrame([(1, "x")], "id long, category string"), "id").collect()
    assert [(r.id, r.category) for r in open_rows] == [(2, "")]


def test_contexts_are_rebuilt(spark):
    from proofmill.operators import documents

    rows = [(1, 2, "kept", "bé", None), (1, 1, "truncated", "alpha", 3), (1, 3, "dropped", "z", None), (2, 1, "dropped", "q", None)]
    decisions = spark.createDataFrame(rows, "case_id long, rank long, disposition string, content string, taken int")
    made = {r.case_id: r for r in documents.visible_context(decisions).collect()}
    assert made[1].context == "alp\n\nbé" and made[1].bytes == 8 and made[2].context == ""
    said = documents.visible_context(decisions).drop("context").withColumn("bytes", F.when(F.col("case_id") == 1, 7).otherwise(F.col("bytes")))
    assert codes(documents.context_issues(said, decisions)) == [("bytes", "1")]
