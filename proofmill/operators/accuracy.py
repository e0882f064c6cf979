"""Accuracy, pairs of arms and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.functions.exact import half_up, mcnemar_exact, rational, signed_delta, wilson_bound


def binary_outcome(completed: Column, judged: Column, num: Column, den: Column) -> Column:
    """True or false where a case is completed and judged with 0 or 1 of 1; else null, which is not false."""
    return F.when(completed & judged & num.isin(0, 1) & (den == 1), num == 1)


def accuracy_slices(cases: DataFrame, stratum: str, outcome: str, total: str = "total") -> DataFrame:
    """Judged and correct cases with Wilson bounds, per stratum and over all.

    One pass: grouping sets over the stratum. The total's label has to be no stratum of the data.
    """
    grouped = cases.rollup(stratum).agg(F.count(outcome).alias("judged"), F.count_if(F.col(outcome)).alias("correct"), F.count("*").alias("cases"), F.grouping(stratum).alias("_all"))
    return grouped.select(
        F.when(F.col("_all") == 1, F.lit(total)).otherwise(F.col(stratum)).alias("stratum"), "cases", "judged", "correct",
        wilson_bound(F.col("correct"), F.col("judged"), upper=False).alias("wilson_lower"), wilson_bound(F.col("correct"), F.col("judged"), upper=True).alias("wilson_upper"),
    )


def exact_mean(cases: DataFrame, by: list[str], num: str, den: str) -> DataFrame:
    """The exact mean of fractions of one denominator per group, as a reduced fraction; mixed ones are an error."""
    sums = cases.groupBy(*by).agg(F.sum(num).alias("_n"), F.min(den).alias("_low"), F.max(den).alias("_high"), F.count("*").alias("cases"), F.count(num).alias("_known"))
    one = F.when((F.col("_low") == F.col("_high")) & (F.col("_known") == F.col("cases")), F.col("_low")).otherwise(F.raise_error(F.lit("a fraction is missing or of another denominator")).cast("long"))
    mean = rational(F.col("_n"), one * F.col("cases"))
    return sums.select(*by, "cases", mean["num"].alias("mean_num"), mean["den"].alias("mean_den"))


def paired(left: DataFrame, right: DataFrame, key: str, outcome: str) -> DataFrame:
    """Outcomes of two arms by case. A case that one arm lacks has a null there: see ``paired_counts``.

    A case that an arm has more than once is in no arm, and null keys meet nothing, so neither is passed off as a pair.
    """
    side = lambda rows, name: rows.groupBy(F.col(key).alias(f"_{name}")).agg(F.first(outcome).alias(f"{name}_outcome"), (F.count("*") == 1).alias(f"_once_{name}"))
    joined = side(left, "left").join(side(right, "right"), F.col("_left") == F.col("_right"), "full_outer")
    once = lambda name: F.coalesce(F.col(f"_once_{name}"), F.lit(False))
    return joined.select(
        F.coalesce("_left", "_right").alias(key), F.when(once("left"), F.col("left_outcome")).alias("left_outcome"), F.when(once("right"), F.col("right_outcome")).alias("right_outcome"),
        once("left").alias("in_left"), once("right").alias("in_right"),
    )


def paired_counts(pairs: DataFrame, by: list[str]) -> DataFrame:
    """The 2 x 2 table of judged pairs, and whether both arms have the same cases."""
    a, b = F.col("left_outcome"), F.col("right_outcome")
    return pairs.groupBy(*by).agg(
        F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("left_only"), F.count_if(~a & b).alias("right_only"), F.count_if(~a & ~b).alias("neither"),
        F.count_if(a.isNull() | b.isNull()).alias("unjudged"), F.bool_and(F.col("in_left") & F.col("in_right")).alias("same_cases"),
    )


def pair_reason() -> Column:
    """Why a row of ``paired_counts`` gives no statistics; null if it does."""
    judged = F.col("both") + F.col("left_only") + F.col("right_only") + F.col("neither")
    return F.when(~F.col("same_cases"), "case_sets_differ").when(F.col("unjudged") > 0, "unjudged_cases").when(judged == 0, "no_cases")


def pair_statistics(counts: DataFrame) -> DataFrame:
    """Exact delta and exact McNemar probability beside a table of ``paired_counts``: a few rows, one per pair.

    Both are null, with a ``reason``, unless the arms have one identical, fully judged set of cases.
    """
    n = F.col("both") + F.col("left_only") + F.col("right_only") + F.col("neither")
    reason = pair_reason()
    delta = F.when(reason.isNull(), signed_delta(F.col("both") + F.col("left_only"), n, F.col("both") + F.col("right_only"), n))
    whole = F.col("reason").isNull()
    known = counts.withColumn("reason", reason).withColumn("delta", delta).withColumn("_p", mcnemar_exact("left_only", "right_only"))
    return known.select(
        *counts.columns, "reason", F.col("delta.num").alias("delta_num"), F.col("delta.den").alias("delta_den"),
        *[F.when(whole, F.col(f"_p.{part}")).alias(name) for part, name in (("numerator", "p_num"), ("denominator", "p_den"), ("display", "p_display"))],
    )


#: What a pair of cells lacks for a comparison, in the order in which it is said.
PAIR_CHECKS = ("revision", "metric", "judged_coverage", "terminal_coverage", "denominator")


def pair_comparability(pairs: DataFrame) -> DataFrame:
    """``limitations`` and ``comparable`` beside pairs of cells, whose columns are those of a cell after left_ and right_:
    revision (null unless a cell has exactly one), metric, cases, completed, judged and denominator."""
    both = lambda f: f("left") & f("right")
    checks = dict(zip(PAIR_CHECKS, (
        F.col("left_revision") == F.col("right_revision"), F.col("left_metric") == F.col("right_metric"),
        both(lambda s: F.col(f"{s}_judged") == F.col(f"{s}_cases")), both(lambda s: F.col(f"{s}_completed") == F.col(f"{s}_cases")), both(lambda s: F.col(f"{s}_denominator") > 0),
    ), strict=True))
    return pairs.withColumn("limitations", limitations(checks)).withColumn("comparable", F.size("limitations") == 0)


def report_leader(cells: DataFrame, pairs: DataFrame, by: list[str], name: str, num: str, den: str, complete: str) -> DataFrame:
    """Per report: the arm of the one highest exact score if it also leads each of its pairs, else what failed.

    ``cells`` has a row per arm, ``pairs`` one per pair with left_{name}, right_{name} and leader (an arm or null). The
    predicates are, in order, complete_equal_coverage, unique_highest_accuracy and all_pairwise_thresholds. Scores are
    compared by cross products, so no rounding decides.
    """
    other = cells.select(*[F.col(c).alias(f"_{c}") for c in by], F.col(name).alias("_name"), F.col(num).alias("_num"), F.col(den).alias("_den"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    wide = "decimal(38,0)"
    mine, theirs = F.col(num).cast(wide) * F.col("_den").cast("decimal(19,0)"), F.col("_num").cast(wide) * F.col(den).cast("decimal(19,0)")
    against = cells.join(other, [*same, F.col(name) != F.col("_name")], "left").groupBy(*by, name, complete).agg(F.bool_and(F.coalesce(mine > theirs, F.col("_name").isNull())).alias("_top"), F.count("_name").alias("_others"))
    won = pairs.select(*by, F.explode(F.array(f"left_{name}", f"right_{name}")).alias(name), "leader").groupBy(*by, name).agg(F.count_if(F.col("leader") == F.col(name)).alias("_won"))
    won = won.select(*[F.col(c).alias(f"_{c}") for c in by], F.col(name).alias("_name"), "_won")
    each = against.join(won, [*same, F.col(name) == F.col("_name")], "left").withColumn("_clears", F.coalesce("_won", F.lit(0)) == F.col("_others"))
    found = each.groupBy(*by).agg(F.bool_and(F.coalesce(complete, F.lit(False))).alias("_complete"), F.max(F.when(F.col("_top"), F.col(name))).alias("_highest"), F.max(F.when(F.col("_top"), F.col("_clears"))).alias("_clears"))
    failed = F.when(~F.col("_complete"), "complete_equal_coverage").when(F.col("_highest").isNull(), "unique_highest_accuracy").when(~F.col("_clears"), "all_pairwise_thresholds")
    return found.select(*by, F.when(failed.isNull(), F.col("_highest")).alias("leader"), F.coalesce(failed, F.lit("")).alias("failed_predicate"))


def ratio_gate(before: Column, after: Column, size_before: Column, size_after: Column, most: float) -> Column:
    """Whether time grew by at most ``most`` times what the size grew; null sizes or times fail, zero ones too."""
    known = (before > 0) & (size_before > 0) & (after >= 0) & (size_after > 0)
    return F.coalesce(known & (after * size_before <= F.lit(most) * before * size_after), F.lit(False))


def arm_pairs(arms: DataFrame, ordinal: str) -> DataFrame:
    """All unordered pairs of arms, left before right: ``arms`` has one row per arm, a handful, which become one array."""
    one = arms.agg(F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.struct(*arms.columns).alias("arm")))).alias("_all"))
    left = one.select("_all", F.posexplode("_all").alias("_place", "_left"))
    pairs = left.select("_left", F.explode(F.slice("_all", F.col("_place") + 2, F.size("_all"))).alias("_right")).where("_left.o < _right.o")
    return pairs.select(*[F.col(f"_{side}.arm").getField(c).alias(f"{side}_{c}") for side in ("left", "right") for c in arms.columns])


def limitations(checks: dict[str, Column]) -> Column:
    """The names of the checks that fail, in order; a null check fails."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))


def pair_decision(pairs: DataFrame, min_delta: float, max_p: float, delta: str, p: str, complete: str) -> DataFrame:
    """Whom a pair favours: coverage complete, the difference large enough and the exact test below the limit."""
    checks = {"complete_equal_coverage": F.col(complete), "minimum_accuracy_delta": F.abs(delta) >= min_delta, "maximum_exact_mcnemar_p_value": F.col(p) <= max_p}
    failed = limitations(checks)
    leader = F.when((F.size(failed) > 0) | (F.col(delta) == 0), F.lit(None)).when(F.col(delta) > 0, "left").otherwise("right")
    return pairs.withColumn("failed_predicates", F.array_join(failed, ",")).withColumn("leader", leader)


def leader(scores: DataFrame, name: str, num: str, den: str) -> DataFrame:
    """The unique arm of the highest exact score, null on a tie; scores are compared by cross products.

    One row per arm, a handful: the sums reach this operator, not the cases. Arms without a denominator do not compete.
    """
    one = scores.where(F.col(den) != 0).agg(F.collect_list(F.struct(F.col(name).alias("name"), F.col(num).cast("decimal(19,0)").alias("num"), F.col(den).cast("decimal(19,0)").alias("den"))).alias("_all"))
    best = F.filter("_all", lambda x: F.forall("_all", lambda y: x["num"] * y["den"] >= y["num"] * x["den"]))
    return one.select(best.alias("_best")).select(F.when(F.size("_best") == 1, F.element_at("_best", 1)["name"]).alias("leader"), F.size("_best").cast("long").alias("tied"))


def lowest(values: DataFrame, name: str, value: str) -> DataFrame:
    """All arms of the lowest value, by name."""
    best = values.agg(F.min(value).alias("_best"))
    return values.join(F.broadcast(best), F.col(value) == F.col("_best")).agg(F.array_join(F.array_sort(F.collect_list(name)), ",").alias("lowest"))


def unique_highest(values: DataFrame, name: str, value: str) -> DataFrame:
    """The arm of the highest value, null on a tie."""
    best = values.agg(F.max(value).alias("_best"))
    return values.join(F.broadcast(best), F.col(value) == F.col("_best")).agg(F.when(F.count("*") == 1, F.min(name)).alias("highest"))


def context_reduction(low: Column, other: Column) -> Column:
    """By how many percent ``low`` is below ``other``, rounded half up."""
    return half_up((other - low) * 100, other, 0).cast("long")


def control_comparison(left: DataFrame, right: DataFrame, control: str, value: str, claims: Column) -> DataFrame:
    """All claims are null unless every control is in both arms with equal values."""
    a = left.select(F.col(control).alias("_ca"), F.col(value).alias("_va"))
    b = right.select(F.col(control).alias("_cb"), F.col(value).alias("_vb"))
    match = a.join(b, F.col("_ca") == F.col("_cb"), "full_outer").agg(F.coalesce(F.bool_and(F.col("_ca").isNotNull() & F.col("_cb").isNotNull() & F.col("_va").eqNullSafe(F.col("_vb"))), F.lit(False)).alias("comparable"))
    return match.withColumn("claim", F.when(F.col("comparable"), claims))


def near_parity(difference: Column, margin: Column) -> Column:
    return F.when(F.abs(difference) <= margin, "near_parity").when(difference > 0, "left_ahead").otherwise("right_ahead")
