"""The registered queries over whole small tables, against SQL or plain versions."""

from __future__ import annotations

import collections
import glob
import hashlib
import math
import os
import re
import zlib

import duckdb
import numpy as np
import pytest

from proofmill.llm import entries

PUNCT = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def _value(x):
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return None if math.isnan(x) else f"{float(x):.6f}"
    return str(x) if x is not None else None


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, con, name):
    got = entries.queries()[name](spark, sf_dir)
    want = con.execute(entries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    order = sorted(columns)
    assert sorted(repr([_value(r[c]) for c in order]) for r in got.collect()) == sorted(repr([_value(r[columns.index(c)]) for c in order]) for r in want.fetchall())


def components(texts: dict) -> dict:
    """id -> (set size, smallest linked id) by comparing all pairs that share an n-gram."""
    sets = {}
    for d, t in texts.items():
        w = (t or "").encode().translate(PUNCT).split()
        sets[d] = frozenset(zip(*[w[i:] for i in range(5)], strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = collections.defaultdict(list)
    for d in sorted(sets):
        seen = set()
        for g in sets[d]:
            for o in lists[g]:
                if o not in seen:
                    seen.add(o)
                    inter = len(sets[d] & sets[o])
                    if 100 * inter >= 75 * (len(sets[d]) + len(sets[o]) - inter):
                        a, b = find(d), find(o)
                        parent[max(a, b)] = min(a, b)
            lists[g].append(d)
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_op2_against_all_pairs(spark, sf_dir, con):
    want = components(dict(con.execute("SELECT doc_id, text FROM documents").fetchall()))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in entries.queries()["op2_jaccard_join"](spark, sf_dir).collect()}
    assert got == want


def test_op7_against_the_library(spark, sf_dir, con):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    got = {r.doc_id: r for r in entries.queries()["op7_token_output"](spark, sf_dir).collect()}
    for d, t in con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_op6_against_greedy_matching(spark, sf_dir, con):
    import public_tokenizers

    from proofmill.llm.wordpiece import LAST, load_pieces

    pieces = set(load_pieces(public_tokenizers.path("word_bpe_49k.json"))) | {(s,) for s in range(512)}
    longest = max(map(len, pieces))

    def count(word: bytes) -> int:
        symbols, n = (*word[:-1], word[-1] + LAST), 0
        while symbols:
            k = next(k for k in range(min(longest, len(symbols)), 0, -1) if symbols[:k] in pieces)
            symbols, n = symbols[k:], n + 1
        return n

    got = {r.doc_id: (r.n_words, r.n_pieces) for r in entries.queries()["op6_token_counts"](spark, sf_dir).collect()}
    for d, t in con.execute("SELECT doc_id, text FROM documents").fetchall():
        words = t.encode().translate(PUNCT).split()
        assert got[d] == (len(words), sum(map(count, words)))


def test_classifiers_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for query, field, fold, rest, limit in (("op5_toxicity", "toxic", 3, 1, 0.95), ("op8_quality", "quality", 5, 0, 0.95)):
        rows = [r for r in entries.queries()[query](spark, sf).collect() if r.doc_id in labels]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold == rest) for r in rows)
        assert all(0 <= r.score <= 1 for r in rows)
        held = [(r.score, r.predicted, getattr(labels[r.doc_id], field)) for r in rows if r.held_out]
        assert sum(p == y for _, p, y in held) / len(held) >= limit
        good, poor = [s for s, _, y in held if y], [s for s, _, y in held if not y]
        auc = np.mean([[(a > b) + 0.5 * (a == b) for b in poor] for a in good])
        assert auc >= 0.93


def test_op9_comes_near_its_targets(spark, sf_dir):
    rows = entries.queries()["op9_mixing"](spark, sf_dir).collect()
    sums, targets, largest = collections.Counter(), {}, collections.Counter()
    for r in rows:
        sums[r.source] += r.taken
        targets[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
        assert r.taken <= 2 * r.size
    assert abs(sum(targets.values()) - 1.5 * sum(r.size for r in rows)) < 1e-3
    assert all(abs(sums[s] - targets[s]) <= 2 * largest[s] for s in targets)
    assert {r.doc_id: r.taken for r in entries.queries()["op9_mixing"](spark, sf_dir).collect()} == {r.doc_id: r.taken for r in rows}


def test_op10_keeps_the_smallest_of_equal_texts(spark, sf_dir, con):
    groups = collections.defaultdict(list)
    norm = {d: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for d, t in con.execute("SELECT doc_id, text FROM documents").fetchall()}
    for d, t in norm.items():
        groups[t].append(d)
    for r in entries.queries()["op10_exact_dedup"](spark, sf_dir).collect():
        group = groups[norm[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(group), len(group), r.doc_id == min(group), hashlib.sha256(norm[r.doc_id].encode()).hexdigest())
