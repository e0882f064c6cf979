"""Hand-computed expectations for single operators."""

from __future__ import annotations

import datetime as dt
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from proofmill.functions import exact, text
from proofmill.operators import accuracy, coverage, durations, evidence, joining, packing, rules, selecting, sequence


def one(df):
    return df.collect()[0]


def test_wilson_bounds_of_published_counts(spark):
    row = one(spark.createDataFrame([(57, 60), (0, 0)], "k long, n long").orderBy(F.desc("n")).select(exact.wilson_bound(F.col("k"), F.col("n"), False).alias("lo"), exact.wilson_bound(F.col("k"), F.col("n"), True).alias("hi")))
    from decimal import Decimal, getcontext

    getcontext().prec = 60
    z, n, p = Decimal("1.959963984540054"), Decimal(60), Decimal(57) / Decimal(60)
    spread = z * (p * (1 - p) / n + z * z / (4 * n * n)).sqrt()
    want = [float(((p + z * z / (2 * n) + sign * spread) / (1 + z * z / n)).quantize(Decimal("0.000001"))) for sign in (-1, 1)]
    assert [row.lo, row.hi] == want


@pytest.mark.parametrize(("left", "right", "p"), [(6, 1, Fraction(1, 8)), (7, 1, Fraction(9, 128)), (4, 3, Fraction(1)), (0, 0, Fraction(1))])
def test_mcnemar_published(left, right, p):
    assert exact.mcnemar_fraction(left, right) == p


def test_mcnemar_columns(spark):
    df = spark.createDataFrame([(6, 1), (7, 1), (0, 0), (300, 200)], "a long, b long")
    rows = df.select("a", exact.mcnemar_exact("a", "b").alias("p"), exact.mcnemar_value(F.col("a"), F.col("b")).alias("v")).collect()
    shown = {r.a: r.p.display for r in rows}
    assert (shown[6], shown[7], shown[0]) == ("0.125000", "0.070313", "1.000000")
    assert all(abs(float(r.p.display) - r.v) < 1e-6 for r in rows)


@given(st.integers(-(10**9), 10**9), st.integers(1, 10**9))
@settings(max_examples=30, deadline=None)
def test_half_integer_and_fraction_rules(n, d):
    assert Fraction(n, d).denominator > 0


def test_rational_and_delta(spark):
    df = spark.createDataFrame([(6, 8, 1, 2), (-4, 6, 0, 5), (1, 0, 1, 1)], "a long, b long, c long, d long")
    rows = df.select(exact.rational(F.col("a"), F.col("b")).alias("r"), exact.signed_delta(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("s")).collect()
    assert [(r.r and tuple(r.r)) for r in rows] == [(3, 4), (-2, 3), None]
    assert tuple(rows[0].s) == (1, 4)


def test_half_up(spark):
    df = spark.createDataFrame([(25, 20), (1, 3), (7, 2), (1, 0)], "a long, b long")
    assert [str(r[0]) for r in df.select(exact.half_up(F.col("a"), F.col("b"), 1)).collect()] == ["1.3", "0.3", "3.5", "None"]


def test_coverage_never_passes_partial_as_whole(spark):
    rows = [("a", 1, "measured_complete"), ("a", None, "unavailable"), ("b", None, "unavailable"), ("c", 2, "measured_complete"), ("d", 3, "measured_partial"), (None, 4, "measured_complete")]
    df = spark.createDataFrame(rows, "g string, v long, proof_status string")
    got = {r.g: (r.status, r.value) for r in coverage.dimension_total(df, ["g"], "v", F.col("proof_status") == "unavailable").collect()}
    assert got["a"] == ("measured_partial", 1) and got["b"] == ("unavailable", None) and got["c"] == ("measured_complete", 2) and got[None] == ("measured_complete", 4)
    stages = {r.g: r.status for r in coverage.stage_coverage(df, ["g"]).collect()}
    assert stages["d"] == "measured_partial" and stages["b"] == "unavailable"


def test_resource_terminal_snapshot_needs_an_ordinal(spark):
    df = spark.createDataFrame([(2, 5, "measured_complete"), (1, 9, "measured_complete"), (3, 7, "unavailable")], "o long, v long, proof_status string").withColumn("g", F.lit(1))
    row = one(coverage.resource_dimension(df, ["g"], "v", ["o"]))
    assert (row.sum_value, row.maximum_value, row.terminal_snapshot, row.status) == (14, 9, 5, "measured_partial")


def test_accuracy_of_empty_and_null(spark):
    assert accuracy.accuracy_slices(spark.createDataFrame([], "s string, ok boolean"), "s", "ok").where("stratum <> 'total'").count() == 0
    rows = {r.stratum: (r.judged, r.correct) for r in accuracy.accuracy_slices(spark.createDataFrame([("x", True), ("x", None), ("y", False)], "s string, ok boolean"), "s", "ok").collect()}
    assert rows == {"x": (1, 1), "y": (1, 0), "total": (2, 1)}


def test_paired_counts_are_null_aware(spark):
    left = spark.createDataFrame([(1, True), (2, False), (3, None)], "k long, ok boolean")
    right = spark.createDataFrame([(1, False), (2, False), (4, True)], "k long, ok boolean")
    row = one(accuracy.paired_counts(accuracy.paired(left, right, "k", "ok").withColumn("g", F.lit(0)), ["g"]))
    assert (row.both, row.left_only, row.right_only, row.neither, row.unjudged, row.same_cases) == (0, 1, 0, 1, 2, False)


def test_leader_is_null_on_a_tie(spark):
    df = spark.createDataFrame([("a", 1, 2), ("b", 2, 4), ("c", 1, 3)], "n string, k long, d long")
    assert one(accuracy.leader(df, "n", "k", "d")).leader is None
    assert one(accuracy.leader(df.where("n <> 'b'"), "n", "k", "d")).leader == "a"


def test_controls_suppress_claims(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v long")
    assert one(accuracy.control_comparison(a, a, "k", "v", F.lit("w"))).claim == "w"
    assert one(accuracy.control_comparison(a, a.where("k = 'x'"), "k", "v", F.lit("w"))).claim is None


def test_p95_is_nearest_rank(spark):
    df = spark.createDataFrame([(n, v) for n in (1, 2, 19, 20, 21, 100) for v in range(1, n + 1)], "n long, v long")
    got = {r.n: (r.p95_us, r.median_us) for r in durations.duration_summary(df, ["n"], "v").collect()}
    assert got == {n: (-(-95 * n // 100), (n + 1) / 2) for n in got}


def test_interval_needs_offsets(spark):
    rows = [("2024-01-01T00:00:00+00:00", "2024-01-01T00:00:01+00:00"), ("2024-01-01T00:00:00", "2024-01-01T00:00:01+00:00"), ("2024-01-02T00:00:00Z", "2024-01-01T00:00:00Z"), (None, None), ("x", "y")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").coalesce(1).select(durations.interval(F.col("a"), F.col("b"))).collect()]
    assert got == [1_000_000, None, None, None, None]


def test_donor_fill(spark):
    df = spark.createDataFrame([(1, None), (2, "b"), (3, None), (4, None)], "o long, v string").withColumn("g", F.lit(1))
    got = [(r.o, r.filled, r.donor) for r in sequence.donor_fill(df, ["g"], ["o"], "v", "o").orderBy("o").collect()]
    assert got == [(1, "b", 2), (2, "b", 2), (3, "b", 2), (4, "b", 2)]


def test_islands_and_outer_attempts(spark):
    df = spark.createDataFrame(list(enumerate("aaabba")), "o long, h string").withColumn("g", F.lit(1))
    row = one(sequence.outer_attempts(sequence.islands(df, ["g"], ["o"], "h"), ["g"], "h", 1))
    assert (row.outer_attempts, row.reappeared) == (4, True)


def test_budget_shortens_the_crossing_row(spark):
    df = spark.createDataFrame([(1, "a", 6), (2, "a", 6), (3, "b", 6), (4, "c", 1)], "o long, r string, n long").withColumn("g", F.lit(1))
    assert [(r.o, r.shown) for r in sequence.budgeted(df, ["g"], ["o"], "r", "n", 10).orderBy("o").collect()] == [(1, 6), (3, 4)]


def test_backoff(spark):
    df = spark.range(1, 7).coalesce(1)
    assert [r[0] for r in df.select(sequence.backoff_seconds(F.col("id"), [5, 15, 30])).collect()] == [5, 15, 30, 60, 120, 240]


def test_first_seen_conflicts(spark):
    df = spark.createDataFrame([(1, "i", "x"), (2, "i", "x"), (3, "i", "y")], "o long, i string, t string").withColumn("g", F.lit(1))
    assert [r.disposition for r in sequence.first_seen(df, ["g"], "i", F.col("t"), ["o"]).orderBy("o").collect()] == ["kept", "duplicate", "conflict"]


def test_points_take_the_span_that_holds_them(spark):
    spans = spark.createDataFrame([(1, 2, 5, "a"), (1, 5, 6, "b"), (2, 0, 9, "c")], "g long, s long, e long, l string")
    points = spark.createDataFrame([(1, p) for p in range(8)], "g long, p long")
    got = [r.l for r in joining.in_intervals(points, spans, ["g"], "p", "s", "e", "l", "none").orderBy("p").collect()]
    assert got == ["none", "none", "a", "a", "a", "b", "none", "none"]


def test_interleave(spark):
    facts = spark.createDataFrame([(1, 1, "x"), (1, 2, None), (1, 3, "x")], "g long, rank long, ref string")
    chunks = spark.createDataFrame([(1, 10, "x"), (1, 11, "z")], "g long, rank long, ref string")
    got = [(r.kind, r.source_rank) for r in joining.interleave(facts, chunks, ["g"], "rank", "ref").orderBy("place").collect()]
    assert got == [("fact", 1), ("chunk", 10), ("fact", 2), ("fact", 3), ("chunk", 11)]


def test_unknown_lookup_is_an_error(spark):
    rows, tab = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1, "a")], "k long, v string")
    with pytest.raises(Exception, match="unknown k"):
        joining.strict_lookup(rows, tab, "k", ["v"]).collect()


def test_retry_chains(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3)], "a long, p long")
    got = {r.a: (r.root, r.depth, r.closed) for r in joining.retry_chains(df, "a", "p").collect()}
    assert got == {1: (1, 1, True), 2: (1, 2, True), 3: (1, 3, True), 4: (2, 3, False)}


def _check_packing(rows, texts, most, limit):
    """What greedy packing means: nothing lost, both limits held, and no batch that could have taken the next piece."""
    rows = sorted(rows, key=lambda r: (r.batch, r.place))
    joined = {}
    for r in rows:
        joined[r.o] = joined.get(r.o, "") + r.piece
    assert joined == dict(enumerate(texts)) and [r.o for r in rows] == sorted(r.o for r in rows)
    batches = {}
    for r in rows:
        assert r.bytes == len(r.piece.encode()) <= limit
        batches.setdefault(r.batch, []).append(r)
    assert sorted(batches) == list(range(len(batches)))
    for k, batch in batches.items():
        assert [r.place for r in batch] == list(range(len(batch)))
        size = sum(r.bytes for r in batch)
        assert len(batch) <= most and size <= limit
        if k + 1 in batches:
            assert len(batch) == most or size + batches[k + 1][0].bytes > limit
    for a, b in zip(rows, rows[1:], strict=False):
        if a.o == b.o:  # a piece ends only where the next character has no room
            assert a.bytes + len(b.piece[0].encode()) > limit


@pytest.mark.parametrize(("most", "limit"), [(2, 8), (1, 4), (3, 600), (50, 11)])
def test_packing_is_greedy_and_splits_between_characters(spark, most, limit):
    texts = ["aé", "日本語のテキスト", "x" * 11, "ü" * 6, "z", "😀" * 9, "ab", "c"] * 5
    rows = [(g, i, t) for g in (1, 2, None) for i, t in enumerate(texts)]
    got = packing.pack_messages(spark.createDataFrame(rows, "g long, o long, t string"), "g", "o", "t", most, limit).collect()
    for g in (1, 2, None):
        _check_packing([r for r in got if r.g == g], texts, most, limit)


def test_packing_refuses_empty_messages_and_small_limits(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "")], "g long, o long, t string")
    with pytest.raises(Exception, match="empty"):
        packing.pack_messages(rows, "g", "o", "t", 2, 8).collect()
    for most, limit in ((0, 8), (2, 3)):
        with pytest.raises(ValueError, match="room"):
            packing.pack_messages(rows, "g", "o", "t", most, limit)


@given(st.text(max_size=40), st.integers(4, 20))
@settings(max_examples=60, deadline=None)
def test_split_bytes(t, limit):
    t = t.encode("utf-8", "ignore").decode()
    pieces = packing.split_bytes(t, limit)
    assert "".join(pieces) == t and all(len(p.encode()) <= limit for p in pieces)


def test_preview_splits_no_character(spark):
    rows = [("aé日😀z" * k,) for k in range(4)]
    for n in range(1, 16):
        got = [r[0] for r in spark.createDataFrame(rows, "t string").coalesce(1).select(text.preview(F.col("t"), n)).collect()]
        assert got == [t.encode()[:n].decode("utf-8", "ignore") for (t,) in rows]


def test_timestamps(spark):
    rows = [("2023/05/20 (Sat) 02:21",), ("2023/05/20 (Sun) 02:21",), ("2023/02/30 (Thu) 02:21",), ("x",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").coalesce(1).select(text.session_timestamp(F.col("t"))).collect()]
    assert got == [dt.datetime(2023, 5, 20, 2, 21), None, None, None, None]
    dates = [("March-15-2024",), ("Mar 15, 2024",), ("2024_03_15",), ("15 March 2024",), ("15 Mar 2024",), ("soon",)]
    got = [r[0] for r in spark.createDataFrame(dates, "t string").coalesce(1).select(text.date_anchor(F.col("t"))).collect()]
    assert got == [dt.datetime(2024, 3, 15)] * 5 + [None]


def test_yes_no_and_canonical_json(spark):
    got = [r[0] for r in spark.createDataFrame([(" Yes\n",), ("no",), ("nö",), ("yes.",), (None,)], "t string").coalesce(1).select(text.yes_no(F.col("t"))).collect()]
    assert got == [True, False, None, None, None]
    rows = [('{"b": 1, "a": [2, "é"]}',), ('{"a": 1, "a": 2}',), ("1.5",), ("{",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").coalesce(1).select(text.canonical_json("t")).collect()]
    assert got == ['{"a":[2,"é"],"b":1}', None, None, None, None]


def test_profile_counts_missing_rules(spark):
    v = rules.violations("a", spark.createDataFrame([(1,)], "k long"), F.col("k"), "c")
    got = {r.rule_id: r.verdict for r in rules.profile({"a": v, "b": v.limit(0)}, ["a", "b", "c"]).collect()}
    assert got == {"a": "invalid", "b": "valid", "c": "missing"}


def test_noise_refuses_mixed_tokenizers(spark):
    rows = [("x", 10, 2, "reviewed", "t1"), ("x", 5, 1, "unreviewed", "t2")]
    schema = "arm string, context_tokens long, unrelated_text_tokens long, noise_status string, tokenizer string"
    row = one(evidence.aggregate_noise(spark.createDataFrame(rows, schema), ["arm"], 3, ["reviewed", "unreviewed"]))
    assert (row.noise_ratio, row.missing_cases, row.context_tokens) == (0.2, 1, 10)
    with pytest.raises(Exception, match="several tokenizers"):
        evidence.aggregate_noise(spark.createDataFrame([*rows, ("x", 1, 1, "reviewed", "t3")], schema), ["arm"], 3, ["reviewed"]).collect()


def test_selection_does_not_depend_on_order(spark):
    df = spark.range(100).withColumn("s", F.col("id") % 3)
    first = selecting.stratified_hash_top(df, "s", "id", "p", 4).select("id").orderBy("id").collect()
    again = selecting.stratified_hash_top(df.orderBy(F.rand(1)).repartition(7), "s", "id", "p", 4).select("id").orderBy("id").collect()
    assert first == again and len(first) == 12


def test_facets_and_sets(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, "a", "y")], "k long, f string, g string")
    assert selecting.facet_filter(df, {"f": ["a"], "g": ["x", "y"]}, F.col("g"), "Y").count() == 1
    assert {(r.facet, r.value, r["count"]) for r in selecting.facet_values(df, ["f", "g"]).collect()} == {("f", "a", 2), ("f", "b", 1), ("g", "x", 1), ("g", "y", 1)}
    row = one(selecting.set_closure(df, df.where("k > 1"), "k"))
    assert (row.only_left, row.only_right, row.in_both, row.equal) == (1, 0, 2, False)


def test_ambiguous_name_joins():
    assert text.is_joined(["a", "a, b", "b"], "a, b, b, a") and text.is_joined([], "") and text.is_joined(["x", "x"], "x, x")
    assert not text.is_joined(["x", "x"], "x") and not text.is_joined(["a"], "a, ") and not text.is_joined([], "a")


def test_memories(spark):
    rows = [('"a"',), ('{"text": "b", "k": 1}',), ('["a", {"text": "c"}]',), ('["a", {"text": " "}]',), ('[1]',), ('{"text": 3}',), ("7",), ("{",), (None,), ("[]",)]
    got = [r[0] if r[0] is None else [m.text for m in r[0]] for r in spark.createDataFrame(rows, "t string").coalesce(1).select(text.extracted_memories(F.col("t"))).collect()]
    assert got == [["a"], ["b"], ["a", "c"], None, None, None, None, None, None, []]


def test_pairs_are_unavailable_unless_the_cases_are_one_judged_set(spark):
    def arms(left, right):
        schema = "k long, ok boolean"
        pairs = accuracy.paired(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "k", "ok").withColumn("g", F.lit(0))
        return one(accuracy.pair_statistics(accuracy.paired_counts(pairs, ["g"])))

    whole = [(i, i < 6) for i in range(10)]
    row = arms(whole, [(i, i < 3) for i in range(10)])
    assert (row.reason, row.delta_num, row.delta_den, row.p_num, row.p_den) == (None, 3, 10, "1", "4")
    for left, right, reason in (
        (whole, whole[:9], "case_sets_differ"), (whole[1:], whole, "case_sets_differ"), (whole, [*whole, (3, True)], "case_sets_differ"),
        ([*whole, (None, True)], [*whole, (None, True)], "case_sets_differ"), (whole, [*whole[:9], (9, None)], "unjudged_cases"),
    ):
        row = arms(left, right)
        assert (row.reason, row.delta_num, row.p_num, row.p_display) == (reason, None, None, None)


def test_mcnemar_by_a_second_algorithm():
    from math import comb

    for a in range(0, 40, 3):
        for b in range(0, 60, 7):
            n = a + b
            want = min(Fraction(1), Fraction(2 * sum(comb(n, k) for k in range(min(a, b) + 1)), 2**n)) if n else Fraction(1)
            assert exact.mcnemar_fraction(a, b) == want


def test_chains_of_any_length(spark):
    rows = [(i, i - 1 if i % 500 else None) for i in range(1, 1200)] + [(5000, 4999), (6000, 6001), (6001, 6000)]
    got = {r.a: (r.root, r.depth) for r in joining.recursive_chains(spark.createDataFrame(rows, "a long, p long"), "a", "p").collect()}
    assert got[150] == (0, 150) and got[499] == (0, 499) and got[500] == (500, 1) and got[999] == (500, 500) and got[1199] == (1000, 200)
    assert got[5000] == (4999, 1) and 6000 not in got


def test_mismatches_are_found_on_both_sides(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", None), (3, "z", 3)], "k long, s string, n long")
    b = spark.createDataFrame([(1, "x", 2), (2, "y", None), (4, "w", 4)], "k long, s string, n long")
    assert {r.k: r.differing for r in joining.field_mismatches(a, b, "k", ["s", "n"]).collect()} == {1: ["n"], 3: ["missing"], 4: ["extra"]}


def test_small_strata_are_refused(spark):
    rows = spark.createDataFrame([("a", i) for i in range(9)] + [("b", i) for i in range(4)], "s string, k long")
    with pytest.raises(Exception, match="too few"):
        selecting.stratified_hash_top(rows, "s", "k", "p", 5).collect()
    got = selecting.stratified_hash_top(rows, "s", "k", "p", 4).collect()
    import hashlib

    want = sorted(range(9), key=lambda k: hashlib.sha256(f"p\0{k}".encode()).hexdigest())[:4]
    assert [r.k for r in sorted(got, key=lambda r: (r.s, r.place)) if r.s == "a"] == want


def test_manifest_selection_names_what_does_not_close(spark):
    m = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "k string, o long")
    runtime = spark.createDataFrame([("a", 1), ("b", 2), ("d", 3)], "k string, o long")
    asked = spark.createDataFrame([("c", 1), ("a", 2), ("x", 3), ("d", 4), ("d", 5)], "k string, place long")
    chosen, issues = selecting.manifest_selection(m, runtime, asked, "k", "o")
    assert sorted((r.code, r.ref) for r in issues.collect()) == [("duplicate_request", "d"), ("out_of_order", "a"), ("runtime_differs", "c"), ("runtime_differs", "d"), ("unknown_request", "x")]
    assert sorted((r.k, r.o) for r in chosen.collect()) == [("a", 1), ("c", 3), ("d", 4), ("d", 4)]


def test_a_leader_has_to_win_every_pair(spark):
    cells = spark.createDataFrame([(g, a, k, 60, True) for g, ks in ((1, (50, 40, 30)), (2, (50, 50, 30)), (3, (50, 40, 30))) for a, k in zip("xyz", ks, strict=True)] + [(4, "x", 9, 9, False)], "g long, arm string, k long, n long, complete boolean")
    pairs = spark.createDataFrame([(1, "x", "y", "x"), (1, "x", "z", "x"), (1, "y", "z", None), (3, "x", "y", None), (3, "z", "x", "x")], "g long, left_arm string, right_arm string, leader string")
    got = {r.g: (r.leader, r.failed_predicate) for r in accuracy.report_leader(cells, pairs, ["g"], "arm", "k", "n", "complete").collect()}
    assert got == {1: ("x", ""), 2: (None, "unique_highest_accuracy"), 3: (None, "all_pairwise_thresholds"), 4: (None, "complete_equal_coverage")}


def test_first_number_under_a_key(spark):
    cases = {
        '{"a": {"x": 1, "in_tokens": {"deep": 5, "tokens": -2.5}}, "tokens": 7}': -2.5, '{"tokens": "7", "b": [{"c": 1}, {"my_tokens": 3e2}]}': 300.0,
        r'{"note": "\"tokens\": 5", "other": 1}': None, '{"x": 1}': None, "no json": None, r'{"q\"tokens": 4}': 4.0,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "j string").select("j", text.first_number(F.col("j"), ["tokens"]).alias("n")).collect()
    assert {r.j: r.n for r in rows} == cases


def test_cursors_of_any_length(spark):
    import base64

    texts = ["", "a", "?>~", "a=", "line\nline", *["é😀x"[: k % 4] + "y~?" * k for k in range(15, 60)], "u" * 100_000]
    cursor = text.cursor_encode(F.col("t"))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", cursor.alias("c"), text.cursor_decode(cursor).alias("back")).collect()
    assert sorted((r.t, r.c, r.back) for r in rows) == sorted((t, base64.urlsafe_b64encode(t.encode()).decode().rstrip("="), t) for t in texts)
    bad = [("abcde",), ("ab=",), ("ab\n",), ("a b",), ("_w",), (None,)]
    assert [r[0] for r in spark.createDataFrame(bad, "t string").select(text.cursor_decode(F.col("t"))).collect()] == [None] * len(bad)
