"""Visible evidence, token spans and noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.operators.joining import in_intervals
from proofmill.operators.sequence import first_seen, labels


def visible_evidence(candidates: DataFrame, by: list[str], identity: str, content: str, order: list[str], is_source: Column) -> DataFrame:
    """Every candidate with its disposition; kept ones carry labels S1, F1, … in order."""
    seen = first_seen(candidates, by, identity, F.col(content), order)
    kept = labels(seen.where("disposition = 'kept'"), by, is_source, order)
    tagged = kept.select(*[F.col(c).alias(f"_{c}") for c in [*by, identity]], "label")
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*by, identity]]
    return seen.join(tagged, on, "left").drop(*[f"_{c}" for c in [*by, identity]])


def evidence_counts(decided: DataFrame, by: list[str]) -> DataFrame:
    d = F.col("disposition")
    return decided.groupBy(*by).agg(F.count("*").alias("candidates"), F.count_if(d == "kept").alias("kept"), F.count_if(d == "duplicate").alias("dropped"), F.count_if(d == "conflict").alias("conflicts"))


def word_offsets(texts: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, offset): where each word of a text begins, in characters, from the pieces that end in one blank."""
    parts = F.split(F.col(text), "(?<= )", -1)
    steps = F.transform(parts, lambda p, i: F.struct(F.length(p).alias("n"), i.alias("i"), (F.trim(p) != "").alias("word")))
    folded = F.aggregate(
        steps, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, x: F.struct((acc["at"] + x["n"]).alias("at"), F.when(x["word"], F.array_append(acc["out"], acc["at"])).otherwise(acc["out"]).alias("out")), lambda acc: acc["out"],
    )
    return texts.select(*key, F.explode(folded).alias("offset"))


def tokens_by_category(tokens: DataFrame, spans: DataFrame, by: list[str], categories: list[str], default: str) -> DataFrame:
    """Tokens per context and category, with 0 for categories that a context lacks."""
    held = in_intervals(tokens, spans, by, "offset", "start", "end", "category", default)
    counts = held.groupBy(*by).agg(*[F.count_if(F.col("category") == c).alias(c) for c in categories])
    return counts.unpivot(by, categories, "category", "tokens")


def noise_status(total: Column, conservative: Column, uncertain: Column, reasons: Column, measurement: Column) -> Column:
    """The status of a context; the first condition that holds decides."""
    return (
        F.when(total == 0, "empty_context").when(conservative, "lower_bound").when(uncertain, "uncertain").when(reasons, "unreviewed").when(measurement == "lower_bound", "lower_bound").otherwise("reviewed")
    )


def aggregate_noise(rows: DataFrame, by: list[str], expected: int, statuses: list[str]) -> DataFrame:
    """Token-weighted noise over reviewed contexts only, and how many contexts have each status.

    Reviewed contexts of several tokenizers are an error: their tokens do not add up.
    """
    reviewed = F.col("noise_status") == "reviewed"
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("saved_cases"), *[F.count_if(F.col("noise_status") == s).alias(f"{s}_cases") for s in statuses], F.sum(F.when(reviewed, F.col("context_tokens"))).alias("_total"),
        F.sum(F.when(reviewed, F.col("unrelated_text_tokens"))).alias("_noise"), F.count_distinct(F.when(reviewed, F.col("tokenizer"))).alias("_tokenizers"),
    )
    ratio = F.when(F.col("_tokenizers") > 1, F.raise_error(F.lit("several tokenizers")).cast("double")).when(F.col("_total") > 0, F.col("_noise") / F.col("_total"))
    return sums.select(*by, "saved_cases", (F.lit(expected) - F.col("saved_cases")).alias("missing_cases"), *[f"{s}_cases" for s in statuses], F.coalesce("_total", F.lit(0)).alias("context_tokens"), F.coalesce("_noise", F.lit(0)).alias("unrelated_text_tokens"), ratio.alias("noise_ratio"))
