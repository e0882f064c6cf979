"""Text and timestamp expressions."""

from __future__ import annotations

import ast
import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def session_timestamp(text: Column) -> Column:
    """``YYYY/MM/DD (Www) HH:MM`` as UTC; null for another form, an invalid date or a weekday that is not the date's."""
    pattern = rf"^(\d{{4}})/(\d{{2}})/(\d{{2}}) \(({'|'.join(_DAYS)})\) (\d{{2}}):(\d{{2}})$"
    plain = F.regexp_replace(text, pattern, "$1-$2-$3 $5:$6")
    parsed = F.when(text.rlike(pattern), F.try_to_timestamp(plain, F.lit("yyyy-MM-dd HH:mm")))
    return F.when(F.date_format(parsed, "EEE") == F.regexp_extract(text, pattern, 4), parsed)


def date_anchor(text: Column) -> Column:
    """A date in any of five written forms; null if it is in none."""
    plain = F.trim(F.regexp_replace(F.translate(text, "_-,", "   "), r"\s+", " "))
    forms = ("MMMM d yyyy", "MMM d yyyy", "yyyy M d", "d MMMM yyyy", "d MMM yyyy")
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(form)) for form in forms])


def evidence_timestamp(text: Column) -> Column:
    """UTC text with microseconds from text with an offset; null if the offset is missing."""
    stamp = F.when(text.rlike(r"(Z|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(text))
    return F.concat(F.date_format(F.to_utc_timestamp(stamp, "UTC"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def seconds_text(micros: Column) -> Column:
    """Microseconds as decimal seconds without trailing zeros."""
    text = (micros.cast("decimal(28,6)") / F.lit(1_000_000).cast("decimal(10,0)")).cast("decimal(38,6)").cast("string")
    return F.regexp_replace(text, r"\.?0+$", "")


def yes_no(text: Column) -> Column:
    """True or false from yes or no between ASCII blanks, in either case; null for anything else."""
    word = F.lower(F.btrim(text, F.lit(" \t\r\n")))
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), F.when(word == "yes", F.lit(True)).when(word == "no", F.lit(False)))


def answer_text(text: Column) -> Column:
    """The answer of a JSON object that has exactly the keys reasoning and answer; null otherwise."""
    keys = F.array_sort(F.json_object_keys(text))
    return F.when(keys == F.array(F.lit("answer"), F.lit("reasoning")), F.get_json_object(text, "$.answer"))


def whitespace_tokens(text: Column) -> Column:
    trimmed = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, " ", -1))).cast("long")


def turn_prefix(anchor: Column, turn: Column, role: Column, content: Column) -> Column:
    """``[anchor | Turn 3] User: content``; absent labels leave no brackets."""
    labels = F.concat_ws(" | ", F.when(anchor != "", anchor), F.when(turn != "", F.concat(F.lit("Turn "), turn)))
    return F.concat(F.when(labels != "", F.concat(F.lit("["), labels, F.lit("] "))).otherwise(""), F.initcap(role), F.lit(": "), content)


def judge_template(question_type: Column, question_id: Column, by_type: dict[str, str], abstention: str) -> Column:
    """The template of a question type; ids that end in _abs have their own."""
    table = F.create_map(*[F.lit(x) for pair in by_type.items() for x in pair])
    return F.when(question_id.endswith("_abs"), abstention).otherwise(F.element_at(table, question_type))


def mentioned(text: Column, patterns: dict[str, str]) -> Column:
    """The names whose pattern the text matches, in order."""
    return F.array_compact(F.array(*[F.when(F.lower(text).rlike(p), F.lit(n)) for n, p in patterns.items()]))


def percent_text(num: Column, den: Column) -> Column:
    """A rate in percent with one decimal, half up."""
    scaled = F.call_function("div", 2 * num * 1000 + den, 2 * den)
    return F.concat((scaled.cast("decimal(20,0)") / F.lit(10)).cast("decimal(20,1)").cast("string"), F.lit("%"))


def cursor_encode(text: Column) -> Column:
    """Base64 for URLs, without padding and without the line breaks that Spark sets after each 76 characters."""
    return F.translate(F.base64(text.cast("binary")), "+/=\r\n", "-_")


def cursor_decode(text: Column) -> Column:
    """The text of a cursor; null for what is none: other characters, an impossible length or bytes that are no UTF-8."""
    padded = F.concat(F.translate(text, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(text), F.lit(4))))
    cursor = text.rlike(r"^[A-Za-z0-9_-]*\z") & (F.length(text) % 4 != 1)
    return F.when(cursor, F.try_validate_utf8(F.unbase64(padded).cast("string")))


def path_name(uri: Column) -> Column:
    """The last part of a URI."""
    return F.element_at(F.split(F.rtrim(uri, F.lit("/")), "/"), -1)


def preview(text: Column, max_bytes: int) -> Column:
    """The longest beginning of a text that fits in so many UTF-8 bytes and splits no character.

    A byte prefix is cut back to the last byte that begins a character if that character is not whole.
    """
    data = F.encode(text, "UTF-8")
    cut = F.substring(data, 1, max_bytes)
    tail = F.hex(F.substring(data, max_bytes + 1, 1))
    whole = F.octet_length(data) <= max_bytes
    # the next byte is a continuation byte (10xxxxxx) only if the cut is inside a character
    broken = tail.rlike("^[89AB]")
    lead = F.regexp_extract(F.hex(cut), "^((?:..)*?)(?:[C-F].(?:[89AB].)*)?$", 1)
    return F.when(whole, text).when(broken, F.decode(F.unhex(lead), "UTF-8")).otherwise(F.decode(cut, "UTF-8"))


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON with sorted keys, compact, non-ASCII kept; null for invalid JSON, for floats and for repeated keys.

    Arbitrary maps have no order in Spark's own JSON writer.
    """

    def unique(pairs: list[tuple[str, object]]) -> dict[str, object]:
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    def no_float(_: str) -> None:
        raise ValueError("float")

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else json.dumps(json.loads(x, object_pairs_hook=unique, parse_float=no_float, parse_constant=no_float), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return text.map(one)


def identity(domain: str, *parts: Column) -> Column:
    """SHA-256 of the canonical JSON array of a domain and parts that are text."""
    items = [F.to_json(F.array(F.lit(domain), *parts))]
    return F.sha2(F.concat(*items).cast("binary"), 256)


@F.pandas_udf(T.StringType())
def literal_json(text: pd.Series) -> pd.Series:
    """JSON from JSON text or else from a Python literal; null if it is neither."""

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        for parse in (json.loads, ast.literal_eval):
            try:
                return json.dumps(parse(x), ensure_ascii=False)
            except (ValueError, SyntaxError, TypeError):
                continue
        return None

    return text.map(one)


@F.pandas_udf(T.StringType())
def render_template(template: pd.Series, variables: pd.Series) -> pd.Series:
    """Replace each {{name}} by its value from a JSON object, in one pass; null unless names and variables are equal sets."""
    import re

    def one(t: str | None, v: str | None) -> str | None:
        if t is None or v is None:
            return None
        values = json.loads(v)
        names = re.findall(r"\{\{(\w+)\}\}", t)
        if set(names) != set(values):
            return None
        return re.sub(r"\{\{(\w+)\}\}", lambda m: str(values[m[1]]), t)

    return pd.Series([one(t, v) for t, v in zip(template, variables, strict=True)])


def first_number(json: Column, keys: list[str]) -> Column:
    """The first number, at any depth and in the order of the text, under a key that contains one of ``keys``; else null.

    Each string is taken whole, with the number that follows its colon if there is one, so what stands inside a string is
    no key.
    """
    tokens = F.regexp_extract_all(json, F.lit(r'"(?:[^"\\]++|\\.)*+"(?:\s*+:\s*+-?[0-9][0-9.eE+-]*+)?'), F.lit(0))
    number = lambda t: F.regexp_extract(t, r":\s*(-?[0-9][0-9.eE+-]*)$", 1)
    name = lambda t: F.regexp_extract(t, r'^"((?:[^"\\]++|\\.)*+)"', 1)
    holds = lambda t: reduce(Column.__or__, [F.contains(name(t), F.lit(k)) for k in keys])
    found = F.filter(tokens, lambda t: (number(t) != "") & holds(t))
    return F.try_element_at(F.transform(found, number), F.lit(1)).cast("double")


def extracted_memories(value: Column) -> Column:
    """An array of (text, entry) from JSON text that holds one memory or a list, each a string or an object with text.

    Entries keep their JSON. Null where an entry is neither or its text is blank or no string.
    """
    v = F.try_parse_json(value)
    several = F.schema_of_variant(v).startswith("ARRAY")
    entries = F.when(several, F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))

    def one(e: Column) -> Column:
        kind = F.schema_of_variant(e)
        text = F.when(kind == "STRING", F.try_variant_get(e, "$", "string")).when(kind.startswith("OBJECT") & (F.schema_of_variant(F.try_variant_get(e, "$.text", "variant")) == "STRING"), F.try_variant_get(e, "$.text", "string"))
        return F.struct(text.alias("text"), F.to_json(e).alias("entry"))

    found = F.transform(entries, one)
    return F.when(v.isNotNull() & F.forall(found, lambda e: F.coalesce(F.trim(e["text"]) != "", F.lit(False))), found)


def is_joined(names: list[str], joined: str, limit: int = 100_000) -> bool:
    """Whether a text is the names, in any order, joined by a comma and a blank; names may hold that too.

    States are what is left of the names after so many characters; more than ``limit`` of them count as no match.
    """
    separator = ", "
    start = tuple(sorted(names))
    if not start:
        return joined == ""
    frontier, seen = [(0, start)], {(0, start)}
    while frontier:
        at, left = frontier.pop()
        for i, name in enumerate(left):
            if i and left[i - 1] == name:
                continue
            rest = left[:i] + left[i + 1 :]
            whole = name if not rest else name + separator
            if not joined.startswith(whole, at):
                continue
            if not rest:
                if at + len(whole) == len(joined):
                    return True
                continue
            state = (at + len(whole), rest)
            if state not in seen:
                if len(seen) >= limit:
                    return False
                seen.add(state)
                frontier.append(state)
    return False


@F.pandas_udf(T.BooleanType())
def names_match(names: pd.Series, joined: pd.Series) -> pd.Series:
    """``is_joined`` by row; null where either is null."""
    return pd.Series([None if n is None or j is None else is_joined(list(n), j) for n, j in zip(names, joined, strict=True)], dtype="boolean")
