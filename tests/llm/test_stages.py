"""Each stage of the pipeline on its own input, against plain Python or SQL; and on edge cases."""

from __future__ import annotations

import re
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from proofmill.llm import mixing, toxicity
from proofmill.llm.common import NON_LETTERS, table, word_hashes
from test_decontamination import plain
from test_links import plain_links

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def inputs(spark, sf_dir, tmp_path_factory):
    """Name of a stage -> (its input, its result), as tables."""
    folder, docs, found = tmp_path_factory.mktemp("stages"), table(spark, sf_dir, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        found[name] = (docs, spark.read.parquet(f"{folder}/{name}"))
        docs = found[name][1]
    return found


def _ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_toxicity_stage(spark, sf_dir, inputs):
    before, after = inputs["toxicity"]
    model = toxicity.train(before, table(spark, sf_dir, "labels"))
    weights = dict(zip(model.words.tolist(), model.weights.tolist(), strict=True))
    keep = []
    for r in before.collect():
        words = set(re.findall(rb"[0-9a-z\x80-\xff]+", (r.text or "").encode().lower()))
        z = model.bias + sum(weights.get(int(h), 0.0) for w in words for _, hs in word_hashes([w], NON_LETTERS) for h in hs)
        if 1 / (1 + np.exp(-z)) < toxicity.THRESHOLD:
            keep.append(r.doc_id)
    assert _ids(after) == sorted(keep) and len(keep) < before.count()


def test_near_duplicate_stage(inputs):
    before, after = inputs["ngram_jaccard"]
    rows = sorted((r.doc_id, r.text) for r in before.collect())
    _, component = plain_links(rows)
    assert _ids(after) == [rows[i][0] for i in range(len(rows)) if component[i] == i]


def test_decontamination_stage(spark, sf_dir, inputs):
    before, after = inputs["decontamination"]
    rows = sorted((r.doc_id, r.text) for r in before.collect())
    bad = {rows[d][0] for d, _ in plain([t for _, t in rows], [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()])}
    assert bad and _ids(after) == [d for d, _ in rows if d not in bad]


def test_mixing_stage(inputs, tmp_path):
    before, after = inputs["mixing"]
    con = duckdb.connect()
    con.register("documents", before.toArrow())
    want = sorted(d for d, n in con.execute(f"SELECT doc_id, copies FROM ({mixing.ORACLE})").fetchall() for _ in range(n))
    assert _ids(after) == want


def test_token_stage(inputs):
    before, after = inputs["token_ids"]
    tokenizer, at, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for d, t in sorted((r.doc_id, r.text) for r in before.collect()):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in after.select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_stages_keep_columns_and_take_edges(spark, sf_dir, edge, empty, name):
    out = STAGES[name](spark, edge, sf_dir)
    rows = out.collect()
    assert out.columns == edge.columns and STAGES[name](spark, empty, sf_dir).count() == 0
    assert all(tuple(r)[5:] == (7, "k", "x", 1, "y", "l", "w", "d", 3) for r in rows)
    ids = sorted(str(r.doc_id) for r in rows)
    every = ["1", "2", "3", "4", "4", "5", "6", "7", "None", "None"]
    if name == "ngram_jaccard":
        assert ids == ["1", "2", "3", "4", "5", "6", "7", "None"]
    elif name != "mixing":
        assert ids == every
    else:
        assert set(ids) <= set(every) and all(ids.count(i) <= 2 * every.count(i) for i in ids)


def test_token_stage_takes_edges(spark, sf_dir, edge, empty):
    rows = STAGES["token_ids"](spark, edge, sf_dir).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "2", "3", "4", "4", "5", "6", "7", "None", "None"]
    assert [r.n_tokens for r in rows if r.doc_id in (1, 2)] == [1, 1] and STAGES["token_ids"](spark, empty, sf_dir).count() == 0


@pytest.mark.parametrize("rows", [1 << 18, 10])
def test_mixing_with_ids_of_one_remainder(spark, frame, monkeypatch, rows):
    monkeypatch.setattr(mixing, "RANGE_ROWS", rows)
    docs = frame([(64 * i, "w " * (i % 90), "ab"[i % 2]) for i in range(600)] + [(None, "a b c", None), (None, "a b c", None), (None, "d", None)])
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = sorted((str(d), s, n) for d, s, n in con.execute(f"SELECT doc_id, size, copies FROM ({mixing.ORACLE})").fetchall())
    got = mixing.mix_sources(docs)
    assert sorted((str(r.doc_id), r.size, r.copies) for r in got.collect()) == want
    assert got.agg({"copies": "sum"}).head()[0] == mixing.emit_mix(docs).count()
