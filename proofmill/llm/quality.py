"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Each token has a fixed sparse ternary index vector, made from its hash. A token's context vector is the sum of its
neighbours' index vectors. For the words of the labelled sample it is summed over all documents; any other token has
the sum of its neighbours where it stands, so no two words are merged. A document is the mean and the spread of its
tokens' normalised vectors and the mean product of neighbours; nothing else of it is an input of the network. A network of two layers in numpy
gives a logit; a temperature fitted on rows kept aside turns it into a probability. Labels come from a bounded sample;
word statistics from every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.llm.common import PIECE, SPACES, _pieces, fold, hash_spans, mix, raw, small_batches

#: The largest number of labelled rows, of either label, that a fit sees.
SAMPLE = (6_000, 6_000)
#: Words of the sample that have a context vector over all documents, the most frequent ones.
VOCABULARY = 1 << 14
#: A vector has SIZE places, of which an index vector fills FILLED with 1 or -1.
SIZE, FILLED = 48, 3
WIDTH = 3 * SIZE + 1
HIDDEN, STEPS, RATE, DECAY = 24, 500, 0.02, 1e-3
THRESHOLD = 0.3
BLOCKS = 64

#: Classes of bytes: 0 blank, 1 letter or byte of a multi-byte character, 2 digit, 3 other mark.
_KIND = np.full(256, 3, np.uint8)
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_KIND[SPACES] = 0


def tokens(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the runs of letters, of digits and of marks."""
    buf = np.frombuffer(data, np.uint8)
    kind = np.zeros(len(buf) + 2, np.uint8)
    kind[1:-1] = _KIND[buf]
    change = np.flatnonzero(kind[1:] != kind[:-1])
    starts, ends = change[:-1], change[1:]
    inside = kind[starts + 1] != 0
    starts, ends = starts[inside], ends[inside]
    return starts, hash_spans(buf, starts, ends)


def _documents(texts: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(rows, cuts, token hashes): some texts at once, text k of them having the tokens from cuts[k] to cuts[k + 1]."""
    group: list[int] = []
    size = 0

    def flush() -> tuple[list[int], np.ndarray, np.ndarray]:
        starts, hashes = tokens(b"\n".join(texts[i] for i in group))
        return group, np.searchsorted(starts, np.cumsum([0, *(len(texts[i]) + 1 for i in group)])), hashes

    for i, t in enumerate(texts):
        if len(t) > PIECE:
            hashes = np.concatenate([tokens(p)[1] for p in _pieces(t, SPACES)])
            yield [i], np.array([0, len(hashes)]), hashes
            continue
        if group and size + len(t) > PIECE:
            yield flush()
            group, size = [], 0
        group.append(i)
        size += len(t) + 1
    if group:
        yield flush()


def _neighbours(cuts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(token, neighbour) for all neighbours within a text."""
    joined = np.ones(max(0, n - 1), bool)
    inner = cuts[1:-1]
    joined[inner[(inner > 0) & (inner < n)] - 1] = False
    left = np.flatnonzero(joined)
    return np.concatenate([left, left + 1]), np.concatenate([left + 1, left])


def index_vectors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the index vectors of tokens, FILLED columns each."""
    h = mix(hashes[:, None] + np.arange(1, FILLED + 1, dtype=np.uint64))
    return (h % np.uint64(SIZE)).astype(np.int64), np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)


def _places(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The place of each token in the sorted words, -1 for others."""
    if not len(words):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
    return np.where(words[at] == hashes, at, -1)


def _contexts(batches: Iterator[pa.RecordBatch], words: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's sums of neighbours' index vectors, as one row for each block of words."""
    total = np.zeros(len(words) * SIZE)
    any_row = False
    for batch in batches:
        for _, cuts, hashes in _documents(raw(batch.column(0))):
            any_row = True
            of, by = _neighbours(cuts, len(hashes))
            word = _places(words, hashes)[of]
            of, by = word[word >= 0], by[word >= 0]
            place, sign = index_vectors(hashes)
            total += np.bincount((of[:, None] * SIZE + place[by]).ravel(), weights=sign[by].ravel(), minlength=len(total))
    if any_row:
        rows = total.astype(np.float32).reshape(BLOCKS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BLOCKS, dtype=np.int32)), pa.array([r.tobytes() for r in rows], pa.binary())], names=["block", "sums"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the blocks in a partition."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(data, np.float32).astype(np.float64)
            sums[block] = sums[block] + x if block in sums else x
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in sums.values()], pa.binary())], names=["block", "sums"])


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-6)


def word_vectors(docs: DataFrame, words: np.ndarray) -> np.ndarray:
    """Normalised context vectors of the sorted words over all documents, and of rows without a word up to VOCABULARY."""
    padded = np.concatenate([words, np.full(VOCABULARY - len(words), np.uint64(2**64 - 1))])
    schema = "block int, sums binary"
    parts = docs.select(F.col("text").cast("string")).mapInArrow(partial(_contexts, words=padded), schema)
    got = parts.repartition(BLOCKS, "block").mapInArrow(_add, schema).toArrow()
    vectors = np.zeros((BLOCKS, VOCABULARY * SIZE // BLOCKS), np.float32)
    for block, data in zip(got.column("block").to_pylist(), got.column("sums").to_pylist(), strict=True):
        vectors[block] = np.frombuffer(data, np.float32)
    return unit(vectors.reshape(VOCABULARY, SIZE))[: len(words)]


def pool(texts: list[bytes], words: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """For each text the mean and the spread of its tokens' vectors, the mean product of vectors that follow each other,
    and 1; zeros without tokens."""
    out = np.zeros((len(texts), WIDTH))
    for rows, cuts, hashes in _documents(texts):
        if not len(hashes):
            continue
        word = _places(words, hashes)
        other = np.flatnonzero(word < 0)
        row_of = np.full(len(hashes), -1)
        row_of[other] = np.arange(len(other))
        of, by = _neighbours(cuts, len(hashes))
        of, by = row_of[of[word[of] < 0]], by[word[of] < 0]
        place, sign = index_vectors(hashes)
        own = np.bincount((of[:, None] * SIZE + place[by]).ravel(), weights=sign[by].ravel(), minlength=len(other) * SIZE).reshape(-1, SIZE)
        every = np.empty((len(hashes), SIZE), np.float32)
        every[word >= 0] = vectors[word[word >= 0]]
        every[other] = unit(own)
        count = np.diff(cuts)
        some = np.flatnonzero(count)
        # the product at a text's first token is with the text before; it is taken out
        follow = np.empty_like(every)
        np.multiply(every[1:], every[:-1], out=follow[1:])
        follow[cuts[some]] = 0
        mean, square, follow = (np.add.reduceat(x, cuts[some], axis=0) / count[some, None] for x in (every, every * every, follow))
        out[np.array(rows)[some]] = np.concatenate([mean, np.sqrt(np.maximum(square - mean * mean, 0)), follow, np.ones((len(some), 1))], axis=1)
    return out


@dataclass(frozen=True)
class Model:
    words: np.ndarray
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh(((x - self.mean) / self.scale) @ self.first + self.first_bias)
        return hidden @ self.second + self.second_bias

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def best_temperature(logit: np.ndarray, good: np.ndarray) -> float:
    """The temperature of the least log loss on rows that the network did not learn from."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    loss = [np.mean(np.logaddexp(0, -np.where(good > 0, 1, -1) * logit / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(x: np.ndarray, good: np.ndarray, words: np.ndarray, vectors: np.ndarray) -> Model:
    """Train on four fifths of the rows, find the temperature on the rest. Without both labels one rate is all."""
    good = np.asarray(good, float)
    if not len(x) or good.min() == good.max():
        rate = (good.sum() + 0.5) / (len(good) + 1.0) if len(good) else 0.5
        return Model(words, vectors, np.zeros(WIDTH), np.ones(WIDTH), np.zeros((WIDTH, 1)), np.zeros(1), np.zeros(1), float(np.log(rate / (1 - rate))), 1.0)
    aside = np.arange(len(x)) % 5 == 4
    if good[~aside].min() == good[~aside].max() or not aside.any():
        aside[:] = False
    mean, scale = x.mean(0), x.std(0) + 0.01
    z, y = ((x - mean) / scale)[~aside], good[~aside]
    rng = np.random.Generator(np.random.PCG64(11))
    params = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    for step in range(1, STEPS + 1):
        some = rng.integers(0, len(z), min(1024, len(z)))
        zi, yi = z[some], y[some]
        hidden = np.tanh(zi @ params[0] + params[1])
        p = 1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3][0], -40, 40)))
        error = (p - yi) / len(yi)
        back = np.outer(error, params[2]) * (1 - hidden**2)
        grads = [zi.T @ back + DECAY * params[0], back.sum(0), hidden.T @ error + DECAY * params[2], np.array([error.sum()])]
        for q, g, m in zip(params, grads, moments, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.999 * m[1] + 0.001 * g**2
            q -= RATE * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    model = Model(words, vectors, mean, scale, params[0], params[1], params[2], float(params[3][0]), 1.0)
    if not aside.any():
        return model
    return Model(words, vectors, mean, scale, params[0], params[1], params[2], float(params[3][0]), best_temperature(model.logits(x[aside]), good[aside]))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, times) of each batch of sampled texts."""
    for batch in batches:
        found = [hashes for _, _, hashes in _documents(raw(batch.column(0)))]
        words, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(times.astype(np.int64))], names=["word", "times"])


def _pooled(batches: Iterator[pa.RecordBatch], words: np.ndarray, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [x.tobytes() for x in pool(raw(batch.column(2)), words, vectors)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(rows, pa.binary())], names=["doc_id", "label", "pooled"])


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = pool(raw(batch.column(1)), model.words, model.vectors)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.probabilities(x) if len(x) else np.zeros(0))], names=["doc_id", "score"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id, 5) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The network on SAMPLE labelled rows at most, none of them held out; their words' vectors over all of ``docs``.

    An id that is labelled more than once is good only if every label says so; null ids and labels are left out.
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_label")).where(F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & ~held_out(F.col("_id")))
    known = known.groupBy("_id").agg(F.min("_label").alias("_label"))
    some = [known.where(F.col("_label") == label).orderBy(F.xxhash64("_id"), "_id").limit(n) for label, n in zip((1, 0), SAMPLE, strict=True)]
    # at most sum(SAMPLE) rows of 12 bytes
    sample = F.broadcast(some[0].union(some[1]))
    rows = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").alias("_text")).join(sample, F.col("_doc") == F.col("_id"))
    counts = rows.select("_text").mapInArrow(_counts, "word long, times long").groupBy("word").agg(F.sum("times").alias("times"))
    # at most VOCABULARY rows of 8 bytes
    words = np.sort(counts.orderBy(F.desc("times"), "word").limit(VOCABULARY).select("word").toArrow().column("word").to_numpy().view(np.uint64))
    vectors = word_vectors(docs, words)
    got = rows.select("_doc", "_label", "_text").mapInArrow(partial(_pooled, words=words, vectors=vectors), "doc_id long, label int, pooled binary").toArrow()
    ids, good = got.column("doc_id").to_numpy(), got.column("label").to_numpy()
    x = np.array([np.frombuffer(p) for p in got.column("pooled").to_pylist()], np.float64).reshape(len(ids), WIDTH)
    order = np.lexsort((good, ids, mix(ids.astype(np.uint64))))
    return fit(x[order], good[order], words, vectors)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each input row: doc_id, held_out, score, predicted.

    Only the text is an input of a score; a null text is an empty one, which pools to zeros. Rows with a null id are
    scored and not held out. Repeated rows are each scored. Empty tables give no rows; without labels of both kinds
    every score is one rate. Other columns are ignored.
    """
    model = train(docs, labels)
    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(partial(_score, model=model), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
