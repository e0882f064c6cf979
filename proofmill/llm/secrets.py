"""Secret scans with a trigram inverted index (DataFrame operations only).

Each rule's regex gives a Boolean query: any of its alternatives, each all of the trigrams that the alternative cannot
do without. Postings of the rules' trigrams are intersected per document; only documents that answer a rule's query are
verified with its regex. A rule with an alternative that lacks trigrams scans every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.llm.common import text_or_empty


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches whose ``group`` has under ``least`` characters are dropped after matching."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules, in the order in which their spans are listed.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Formats of well-known credentials.
MORE = (
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE

#: Character classes and repeats of up to so many choices are written out; an alternative has up to so many in all.
CHOICES, ALTERNATIVES = 6, 64
#: Trigrams that one long has bits for.
BITS = 48
#: Letters by frequency, the rarest last: of a query's trigrams the one of rare letters is looked for first.
FREQUENCY = "etaoinsrhldcumfpgwybvkxjqz"


def _strings(parsed) -> list[tuple[str, ...]]:
    """Alternatives of a parsed regex, each the runs of characters that it must contain; "" marks a break."""
    from re import _constants as op

    found: list[tuple[str, ...]] = [("",)]

    def then(more: list[tuple[str, ...]]) -> None:
        nonlocal found
        joined = [(*a[:-1], a[-1] + b[0], *b[1:]) for a in found for b in more]
        found = joined if len(joined) <= ALTERNATIVES else [(*a, "") for a in found]

    for kind, arg in parsed:
        if kind is op.LITERAL:
            then([(chr(arg),)])
        elif kind is op.IN and all(k is op.LITERAL for k, _ in arg) and len(arg) <= CHOICES:
            then([(chr(x),) for _, x in arg])
        elif kind is op.BRANCH:
            then([s for branch in arg[1] for s in _strings(branch)])
        elif kind is op.SUBPATTERN:
            then(_strings(arg[-1]))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            least, most, inner = arg
            if (least, most) == (0, 1):
                then([("",), *_strings(inner)])
            elif least:
                then([(*s, "") if most != least else s for s in _strings(inner)])
            else:
                then([("", "")])
        else:
            then([("", "")])
    return found


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Any of these sets of trigrams, lower-case, must be in a text that matches; empty if the regex demands none."""
    import re._parser as parser

    sets = {frozenset(run[i : i + 3].lower() for run in runs for i in range(len(run) - 2)) for runs in _strings(parser.parse(pattern))}
    return sorted(sets, key=sorted) if all(sets) else []


def _rarest(trigrams: frozenset[str]) -> str:
    return max(sorted(trigrams), key=lambda t: sum(FREQUENCY.find(c) if c in FREQUENCY else len(FREQUENCY) for c in t))


def _queries(rules: tuple[Rule, ...]) -> list[tuple[str, frozenset[str]]]:
    return [(r.kind, q) for r in rules for q in trigram_query(r.pattern)]


def _row_key(id_col: str, text: Column) -> Column:
    """Rows with one key have the same candidates; a collision only adds a candidate to verify."""
    return F.xxhash64(F.col(id_col), text)


def trigram_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (trigram, row_key) of the trigrams that the rules' queries name."""
    vocabulary = sorted({t for _, q in _queries(rules) for t in q})
    text = text_or_empty(text_col)
    rows = docs.select(_row_key(id_col, text).alias("row_key"), F.lower(text).alias("_lower"))
    # which trigrams a text has, as bits of as many longs as it takes: plain expressions that compile to one loop
    words = [vocabulary[i : i + BITS] for i in range(0, len(vocabulary), BITS)]
    bit = lambda i: F.lit(1 << i).cast("long")
    masks = [reduce(Column.__add__, [F.when(F.contains("_lower", F.lit(t)), bit(i)).otherwise(F.lit(0).cast("long")) for i, t in enumerate(word)]).alias(f"_mask{k}") for k, word in enumerate(words)]
    rows = rows.select("row_key", *masks)
    entries = [F.struct(F.lit(t).alias("t"), F.lit(k).alias("k"), bit(i).alias("bit")) for k, word in enumerate(words) for i, t in enumerate(word)]
    if not entries:
        return rows.select(F.lit("").alias("trigram"), "row_key").limit(0)
    mask = F.array(*[f"_mask{k}" for k in range(len(words))])
    present = F.filter(F.array(*entries), lambda e: F.element_at(mask, e["k"] + 1).bitwiseAND(e["bit"]) != 0)
    return rows.select(F.explode(present).alias("_e"), "row_key").select(F.col("_e.t").alias("trigram"), "row_key")


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(row_key, kinds): the postings of each query intersected, the rule's queries united."""
    spark = postings.sparkSession
    queries = _queries(rules)
    rows = [(n, kind, t, 1 << i, (1 << len(q)) - 1) for n, (kind, q) in enumerate(queries) for i, t in enumerate(sorted(q))]
    if not rows:
        return spark.createDataFrame([], "row_key long, kinds array<string>")
    # one row for each trigram of a rule
    asked = F.broadcast(spark.createDataFrame(rows, "query int, kind string, trigram string, bit long, all long"))
    met = postings.join(asked, "trigram").groupBy("row_key", "query", "kind", "all").agg(F.expr("bit_or(bit)").alias("got")).where(F.col("got") == F.col("all"))
    return met.groupBy("row_key").agg(F.collect_set("kind").alias("kinds"))


_SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of the leftmost matches that do not overlap, in characters: the pieces between them say where they lie."""
    matches, gaps = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.split(text, rule.pattern, -1)
    measured = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
    zipped = F.arrays_zip(matches.alias("m"), measured.alias("g"), F.slice(gaps, F.lit(1), F.size(matches)).alias("gap"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["m"])
        span = F.struct(begin.cast("long").alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.cast("long").alias("end"))
        return F.struct(end.cast("long").alias("at"), F.when(F.length(x["g"]) >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(zipped, start, step, lambda acc: acc["out"])


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_more.

    The base rules always run; ``rules`` add spans of their own kinds. Null text counts as empty; a text without spans
    has an empty list and its digest. Null ids and repeated rows are scanned like any other. An empty table gives no
    rows. Other columns are ignored.
    """
    every = BASE + tuple(rules)
    queries = _queries(every)
    indexed = {kind for kind, _ in queries}
    text = text_or_empty(text_col)
    found = candidates(trigram_index(docs, every, id_col, text_col), every).select(F.col("row_key").alias("_candidate"), "kinds")
    none = F.array().cast(_SPAN)
    # rules without trigrams scan here; texts with no query's rarest trigram are in no list and need not travel
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"), _row_key(id_col, text).alias("row_key"), F.lower(text).alias("_lower"))
    may = F.lit(False)
    for t in sorted({_rarest(q) for _, q in queries}):
        may = may | F.contains("_lower", F.lit(t))
    scanned = [F.when(F.col("_text").rlike(r.pattern), _spans(F.col("_text"), r, k)).otherwise(none) for k, r in enumerate(every) if r.kind not in indexed]
    rows = rows.select("doc_id", "row_key", F.when(may, F.col("_text")).otherwise(F.lit("")).alias("_text"), (F.concat(*scanned) if scanned else none).alias("_scanned"))
    rows = rows.join(found, F.col("row_key") == F.col("_candidate"), "left")
    verified = [F.when(F.array_contains("kinds", r.kind), _spans(F.col("_text"), r, k)).otherwise(none) for k, r in enumerate(every) if r.kind in indexed]
    rows = rows.select("doc_id", F.concat("_scanned", *verified).alias("_spans"))
    count = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("_spans", lambda s: s["rank"] < len(BASE))
    return rows.select(
        "doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE], F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("_spans")).alias("spans"), F.size(F.filter("_spans", lambda s: s["rank"] >= len(BASE))).cast("long").alias("n_more"),
    )


def _sql_spans(rule: Rule, rank: int) -> str:
    p = rule.pattern.replace("'", "''").replace("(?i:", "(?i:")
    matches, gaps = f"regexp_extract_all(t, '{p}')", f"regexp_split_to_array(t, '{p}')"
    return (
        f"SELECT doc_id, row, '{rule.kind}' AS kind, {rank} AS rank, start, start + length(m[k]) AS stop FROM (SELECT doc_id, row, m, g, k, "
        f"(list_sum(list_transform(s[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))), 0))::BIGINT AS start "
        f"FROM (SELECT doc_id, row, m, g, s, unnest(range(1, len(m) + 1)) AS k FROM (SELECT doc_id, row, {matches} AS m, regexp_extract_all(t, '{p}', {rule.group}) AS g, {gaps} AS s FROM d))) WHERE length(g[k]) >= {rule.least}"
    )


ORACLE = (
    "WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS t FROM documents), s AS ("
    + " UNION ALL ".join(_sql_spans(r, k) for k, r in enumerate(RULES))
    + f"""), a AS (SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
 string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < {len(BASE)}) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans,
 count(*) FILTER (rank >= {len(BASE)}) AS n_more FROM s GROUP BY row)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_more, 0) AS n_more
FROM d LEFT JOIN a USING (row)"""
)


def brute_force(text: str | None, rules: tuple[Rule, ...] = RULES) -> str:
    """The spans of a text by plain regex search; for tests."""
    found = []
    for rank, r in enumerate(rules):
        found += [(m.start(), rank, r.kind, m.end()) for m in re.finditer(r.pattern, text or "") if len(m.group(r.group)) >= r.least]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))
