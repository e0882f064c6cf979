"""Words that simple hashes confuse, and stores whose files were altered."""

from __future__ import annotations

import glob
import os
import random
import shutil
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from proofmill.llm import common, idstore, jaccard, wordpiece

PATH = public_tokenizers.path("word_bpe_49k.json")


def _thue_morse(n: int) -> tuple[str, str]:
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def _words() -> list[str]:
    rng = random.Random(3)
    long = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 90))) for _ in range(3000)]
    near = [w[:-1] + "z" for w in long[:500]]
    return [*_thue_morse(1024), *_thue_morse(64), *_thue_morse(32), *long, *near]


def test_distinct_words_have_distinct_hashes_and_numbers():
    words = _words()
    data = " ".join(words).encode()
    starts, ends = common.word_spans(data, common.SPACES)
    buf = np.frombuffer(data, np.uint8)
    assert len(set(common.hash_spans(buf, starts, ends).tolist())) == len(set(words))
    first, which = common.distinct_spans(buf, starts, ends)
    assert [words[first[k]] for k in which] == words and len(first) == len(set(words))


def test_equal_hashes_are_told_apart_by_bytes(monkeypatch):
    monkeypatch.setattr(common, "hash_spans", lambda buf, starts, ends: np.zeros(len(starts), np.uint64))
    words = _words()[:200]
    data = " ".join(words).encode()
    starts, ends = common.word_spans(data, common.SPACES)
    first, which = common.distinct_spans(np.frombuffer(data, np.uint8), starts, ends)
    assert [words[first[k]] for k in which] == words and len(first) == len(set(words))


def test_confusable_words_in_one_batch(frame):
    a, b = _thue_morse(1024)
    docs = frame([(1, a), (2, b), (3, f"{a} x"), (4, f"{b} x")])
    got = {r.doc_id: r for r in jaccard.jaccard_classes(docs).collect()}
    assert [got[k].component_id for k in (1, 2, 3, 4)] == [1, 2, 3, 4]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    for text, ids in zip((a, b), idstore.encode_texts([a.encode(), b.encode()], PATH), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
    pieces = wordpiece.load_pieces(PATH)
    automaton = wordpiece.build(pieces)
    whole = Counter(pieces)

    def greedy(word: bytes) -> int:
        symbols, n = [*word[:-1], word[-1] + wordpiece.LAST], 0
        while symbols:
            k = next(k for k in range(len(symbols), 0, -1) if k == 1 or tuple(symbols[:k]) in whole)
            symbols, n = symbols[k:], n + 1
        return n

    _, counts = wordpiece._word_counts(automaton, f"{a} {b}".encode())
    assert counts.tolist() == [greedy(a.encode()), greedy(b.encode())]


@pytest.fixture
def store(spark, frame, tmp_path):
    rows = [(i, f"text number {i} " + "alpha beta gamma " * (i % 3)) for i in range(40)]
    folder = str(tmp_path / "store")
    idstore.write_store(frame(rows), folder, PATH)
    return folder


def _rewrite(folder: str, change) -> None:
    """Change the rows of the largest recipe file."""
    path = max(glob.glob(f"{folder}/recipes/part=*/*.parquet"), key=lambda p: pq.ParquetFile(p).metadata.num_rows)
    table = pq.ParquetFile(path).read()
    rows = table.to_pylist()
    change(rows)
    pq.write_table(pa.Table.from_pylist(rows, schema=table.schema), path)
    for crc in glob.glob(f"{folder}/recipes/part=*/.*.crc"):
        os.remove(crc)


def _swap(rows):
    a, b = [r for r in rows if r["row"] >= 0 and r["doc_id"] % 3 == 0][:2]
    a["recipe"], b["recipe"] = b["recipe"], a["recipe"]


def _count(rows):
    rows[0]["n_tokens"] += 1


def _lose(rows):
    del rows[0]


def _order(rows):
    rows[0]["row"], rows[1]["row"] = rows[1]["row"], rows[0]["row"]


def _ids(rows):
    rows[0]["doc_id"], rows[1]["doc_id"] = rows[1]["doc_id"], rows[0]["doc_id"]


def _manifest(rows):
    last = next(r for r in rows if r["row"] == -1)
    last["n_tokens"] += 1


@pytest.mark.parametrize("change", [_swap, _count, _lose, _order, _ids, _manifest])
def test_altered_store_is_refused(spark, store, change):
    assert idstore.read_store(spark, store).count() == 40
    _rewrite(store, change)
    with pytest.raises(ValueError, match="Merkle"):
        idstore.read_store(spark, store)


def test_missing_part_is_refused(spark, store):
    shutil.rmtree(sorted(glob.glob(f"{store}/recipes/part=*"))[0])
    with pytest.raises(ValueError, match="Merkle"):
        idstore.read_store(spark, store)


def test_altered_chunk_is_refused(spark, store):
    path = next(p for p in glob.glob(f"{store}/encoded/kind=chunk/*.parquet") if pq.ParquetFile(p).metadata.num_rows)
    table = pq.ParquetFile(path).read()
    rows = table.to_pylist()
    rows[0]["data"] = rows[0]["data"][:-2] + b"\x07\x00"
    pq.write_table(pa.Table.from_pylist(rows, schema=table.schema), path)
    for crc in glob.glob(f"{store}/encoded/kind=chunk/.*.crc"):
        os.remove(crc)
    with pytest.raises(Exception, match="digest"):
        idstore.read_store(spark, store).collect()
