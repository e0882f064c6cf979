"""Exact numbers as columns: rationals, canonical decimals, Wilson bounds and exact tests."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal, localcontext
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the 97.5 % point of the normal distribution that the 95 % interval uses.
WILSON_Z = 1.959963984540054

def gcd(a: Column, b: Column, rounds: int = 92) -> Column:
    """Greatest common divisor of two non-negative longs; Euclid's steps as a fold, 92 being enough for 64 bits."""
    pair = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    step = lambda acc, _: F.when(acc["b"] == 0, acc).otherwise(F.struct(acc["b"].alias("a"), (acc["a"] % acc["b"]).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), pair, step, lambda acc: acc["a"])


def rational(num: Column, den: Column) -> Column:
    """A reduced fraction with a positive denominator; null where the denominator is null or 0."""
    divisor = gcd(F.abs(num), F.abs(den))
    sign = F.when(den < 0, F.lit(-1)).otherwise(F.lit(1))
    part = lambda x: F.call_function("div", sign * x.cast("long"), divisor)
    return F.when(den != 0, F.struct(part(num).alias("num"), part(den).alias("den")))


def signed_delta(n1: Column, d1: Column, n2: Column, d2: Column) -> Column:
    """n1/d1 - n2/d2 as a reduced fraction."""
    return rational(n1 * d2 - n2 * d1, d1 * d2)


def wilson_bound(correct: Column, total: Column, upper: bool) -> Column:
    """A Wilson 95 % bound, rounded half up to six places; null where the total is 0."""
    n, z2 = total.cast("double"), WILSON_Z * WILSON_Z
    p = correct.cast("double") / n
    center = p + F.lit(z2) / (2 * n)
    spread = F.lit(WILSON_Z) * F.sqrt(p * (1 - p) / n + F.lit(z2) / (4 * n * n))
    edge = (center + spread if upper else center - spread) / (1 + F.lit(z2) / n)
    return F.when(total > 0, F.round(edge, 6))


def half_up(numerator: Column, denominator: Column, places: int) -> Column:
    """A quotient of integers, rounded half up in decimals: no step goes through a double."""
    scale = 10**places
    doubled = 2 * numerator.cast("decimal(38,0)") * scale + denominator.cast("decimal(38,0)")
    whole = F.call_function("div", doubled, 2 * denominator.cast("decimal(38,0)"))
    return F.when(denominator != 0, (whole.cast(f"decimal(38,{places})") / F.lit(scale)).cast(f"decimal(38,{places})"))


def mcnemar_fraction(left_only: int, right_only: int) -> Fraction:
    """The two-sided exact probability of a split as uneven as this under equal chances; 1 without discordant pairs."""
    n = left_only + right_only
    if not n:
        return Fraction(1)
    tail, term = 0, 1
    for k in range(min(left_only, right_only) + 1):
        tail += term
        term = term * (n - k) // (k + 1)
    return min(Fraction(1), Fraction(2 * tail, 1 << n))


@F.pandas_udf(T.StructType([T.StructField(c, T.StringType()) for c in ("numerator", "denominator", "display")]))
def mcnemar_exact(left_only: pd.Series, right_only: pd.Series) -> pd.DataFrame:
    """Numerator and denominator as text, for they pass 38 digits, and the value to six places, half up.

    One row per pair of arms reaches this function, after all counting.
    """
    rows = []
    for a, b in zip(left_only, right_only, strict=True):
        p = mcnemar_fraction(int(a), int(b))
        with localcontext() as context:
            context.prec = 60
            display = (Decimal(p.numerator) / Decimal(p.denominator)).quantize(Decimal("0.000001"), rounding=ROUND_HALF_UP)
        rows.append((str(p.numerator), str(p.denominator), format(display, "f")))
    return pd.DataFrame(rows, columns=["numerator", "denominator", "display"])


def mcnemar_value(left_only: Column, right_only: Column) -> Column:
    """The same probability as a double, from a sum of binomial terms by logarithms; for thousands of pairs of arms."""
    n, low = left_only + right_only, F.least(left_only, right_only)
    terms = F.sequence(F.lit(1), F.greatest(low, F.lit(1)))
    start = F.struct((-n * F.lit(math.log(2))).alias("log"), F.exp(-n * F.lit(math.log(2))).alias("sum"))

    def step(acc: Column, k: Column) -> Column:
        log = acc["log"] + F.ln((n - k + 1) / k)
        return F.when(k <= low, F.struct(log.alias("log"), (acc["sum"] + F.exp(log)).alias("sum"))).otherwise(acc)

    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(terms, start, step, lambda acc: acc["sum"])))


def canonical_decimal(value: Column) -> Column:
    """Decimal text without trailing zeros; negative zero is 0."""
    text = value.cast("string")
    stripped = F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    return F.when(stripped.isin("", "-0"), F.lit("0")).otherwise(stripped)


def lenient_decimal(text: Column) -> Column:
    """Decimal from text; null for null, empty and anything that is no plain number."""
    return F.when(text.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), text.try_cast("decimal(38,18)"))


def half_integer_text(doubled: Column) -> Column:
    """Text of half an integer: 7 becomes 3.5."""
    whole = F.call_function("div", doubled, F.lit(2)).cast("string")
    return F.when(doubled % 2 == 0, whole).otherwise(F.concat(whole, F.lit(".5")))
