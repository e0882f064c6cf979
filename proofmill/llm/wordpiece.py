"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary is a trie. A node from which the next byte leads nowhere has a failure link, and the number of pieces
that are complete by then is known beforehand, so each byte is read once and no piece is built. The words of a batch
step through the automaton together.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm.common import PIECE, SPACES, _pieces, distinct_spans, raw, small_batches, word_spans

#: A word's last byte is a symbol of its own, LAST more than the byte: pieces that end a word match nowhere else.
LAST = 256
SYMBOLS = 2 * LAST


@dataclass(frozen=True)
class Automaton:
    edges: np.ndarray  # sorted: node * SYMBOLS + symbol
    targets: np.ndarray
    fail: np.ndarray
    popped: np.ndarray  # pieces that are complete when a node's failure link is taken

    def step(self, nodes: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next node of each word, and the pieces completed on the way."""
        count = np.zeros(len(nodes), np.int64)
        out = np.zeros(len(nodes), np.int64)
        todo, at = np.arange(len(nodes)), nodes
        while len(todo):
            key = at * SYMBOLS + symbols[todo]
            place = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            ok = self.edges[place] == key
            out[todo[ok]] = self.targets[place[ok]]
            todo, at = todo[~ok], at[~ok]
            count[todo] += self.popped[at]
            at = self.fail[at]
        return out, count

    def finish(self, nodes: np.ndarray) -> np.ndarray:
        """The pieces completed at the end of each word."""
        count = np.zeros(len(nodes), np.int64)
        todo = np.flatnonzero(nodes > 0)
        at = nodes[todo]
        while len(todo):
            count[todo] += self.popped[at]
            at = self.fail[at]
            todo, at = todo[at > 0], at[at > 0]
        return count


def build(pieces: list[tuple[int, ...]]) -> Automaton:
    """From pieces as symbols. Every single symbol is made a piece, so each word has an answer."""
    children: list[dict[int, int]] = [{}]
    parent, symbol, depth = [0], [0], [0]
    whole = [False]
    for piece in [*((s,) for s in range(SYMBOLS)), *pieces]:
        node = 0
        for s in piece:
            if s not in children[node]:
                children[node][s] = len(children)
                children.append({})
                parent.append(node)
                symbol.append(s)
                depth.append(depth[node] + 1)
                whole.append(False)
            node = children[node][s]
        whole[node] = True
    n = len(children)
    fail, popped = [0] * n, [0] * n
    for v in sorted(range(1, n), key=depth.__getitem__):
        if whole[v]:
            popped[v] = 1
            continue
        u, s = parent[v], symbol[v]
        z, pops = fail[u], popped[u]
        while s not in children[z]:
            pops += popped[z]
            z = fail[z]
        fail[v], popped[v] = children[z][s], pops
    keys = np.array([v * SYMBOLS + s for v, c in enumerate(children) for s in c], np.int64)
    ends = np.array([t for c in children for t in c.values()], np.int64)
    order = np.argsort(keys)
    return Automaton(keys[order], ends[order], np.array(fail, np.int64), np.array(popped, np.int64))


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(other)}


def load_pieces(path: str, end: str = "</w>") -> list[tuple[int, ...]]:
    """The pieces of a tokenizer file with word ends; its special tokens are no pieces."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    alphabet = _byte_alphabet()
    found = []
    for piece in vocabulary:
        at_end = piece.endswith(end)
        data = [alphabet[c] for c in (piece.removesuffix(end) if at_end else piece)]
        if data:
            found.append((*data[:-1], data[-1] + LAST) if at_end else tuple(data))
    return found


def _word_counts(automaton: Automaton, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and number of pieces of each word of a piece of text; equal words go through the automaton once."""
    starts, ends = word_spans(data, SPACES)
    if not len(starts):
        return starts, np.zeros(0, np.int64)
    buf = np.frombuffer(data, np.uint8)
    first, which = distinct_spans(buf, starts, ends)
    begin, size = starts[first], (ends - starts)[first]
    buf = buf.astype(np.int64)
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    nodes, count = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
    for j in range(int(size[0])):
        live = int(np.searchsorted(-size, -j, side="left"))  # words longer than j come first
        symbols = buf[begin[:live] + j] + np.where(size[:live] == j + 1, LAST, 0)
        nodes[:live], done = automaton.step(nodes[:live], symbols)
        count[:live] += done
    count += automaton.finish(nodes)
    back = np.empty(len(order), np.int64)
    back[order] = count
    return starts, back[which]


def _count(batches: Iterator[pa.RecordBatch], automaton: Automaton) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.lower() for t in raw(batch.column(1))]
        words, pieces = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        group: list[int] = []
        size = 0

        def flush(group: list[int], texts: list[bytes] = texts, words: np.ndarray = words, pieces: np.ndarray = pieces) -> None:
            starts, counts = _word_counts(automaton, b"\n".join(texts[i] for i in group))
            cuts = np.searchsorted(starts, np.cumsum([0, *(len(texts[i]) + 1 for i in group)]))
            sums = np.concatenate([[0], np.cumsum(counts)])
            words[group], pieces[group] = np.diff(cuts), np.diff(sums[cuts])

        for i, t in enumerate(texts):
            if len(t) > PIECE:
                for part in _pieces(t, SPACES):
                    counts = _word_counts(automaton, part)[1]
                    words[i] += len(counts)
                    pieces[i] += counts.sum()
                continue
            if group and size + len(t) > PIECE:
                flush(group)
                group, size = [], 0
            group.append(i)
            size += len(t) + 1
        if group:
            flush(group)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(pieces)], names=["doc_id", "n_words", "n_pieces"])


def count_pieces(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_words, n_pieces.

    Words are runs without ASCII white space, with letters A-Z as lower case. A word's pieces are the longest match at
    each place; pieces that end a word match only there, and every byte is a piece. Null and empty texts have no
    words. Null ids and repeated rows are counted like any other. An empty table gives no rows. Other columns are
    ignored.
    """
    small_batches(docs.sparkSession)
    automaton = build(load_pieces(vocabulary_path))
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(partial(_count, automaton=automaton), "doc_id long, n_words long, n_pieces long")
