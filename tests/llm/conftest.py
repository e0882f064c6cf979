from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, _key string, size string, start int, score string, label string, words string, _doc string, row_key int"


@pytest.fixture(scope="session")
def frame(spark):
    """Rows (doc_id, text[, source]) as documents with columns whose names clash with the operators' own."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 7, "k", "x", 1, "y", "l", "w", "d", 3) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def edge(frame):
    """Nulls, empty and blank texts, a very long text, ties and repeated rows."""
    long_text = " ".join(f"w{i % 997}x{i % 13}" for i in range(400_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (4, "a"), (5, "one two three four five six seven"), (None, "one two three four five six seven"), (6, long_text), (7, "ÉÜñ 日本 😀"), (None, None)]
    return frame(rows)


@pytest.fixture(scope="session")
def empty(frame, edge):
    return edge.limit(0)
