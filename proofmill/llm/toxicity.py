"""Toxicity classifier with counterfactual regularisation.

A linear classifier over the presence of words. Beside the log loss of labelled texts, training penalises the change
of a sentence's score when an identity term in it is swapped for another of its group: each labelled sentence with such
a term is written again with every other term, both are scored, and the squared difference is part of the loss. So a
neutral mention of a group does not move the score. Fitting sees a bounded sample of labelled rows; scoring sees every
text whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.llm.common import NON_LETTERS, fold, raw, small_batches, word_hashes

#: The largest number of labelled rows, toxic and other, that a fit sees.
SAMPLE = (3_000, 6_000)
#: The words that a fit can use: those of at least LEAST_TEXTS sampled texts, the WORDS that tell most about the label.
WORDS, LEAST_TEXTS = 8_192, 3
#: The weight of the sum of absolute weights in the fit that selects words, and its steps.
LASSO, LASSO_STEPS = 0.006, 300
RIDGE, SWAP_PENALTY, STEPS, RATE = 0.1, 20.0, 400, 0.1
THRESHOLD = 0.7

#: Terms that name groups of people; a swap replaces a term by another of its row.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("frauen", "männer"),
    ("christen", "muslime", "juden"),
    ("femmes", "hommes"),
    ("chrétiens", "musulmans", "juifs"),
    ("mujeres", "hombres"),
    ("cristianos", "musulmanes", "judíos"),
)


def _words(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(row, distinct hashes of its runs of letters and digits) for each text; letters A-Z count as lower case."""
    for i, words in word_hashes([t.lower() for t in texts], NON_LETTERS):
        yield i, np.unique(words)


#: What stands for a sentence's end.
_SENTENCE = re.compile(rb"[.!?\n]+")
_TERMS = {t.encode(): [u.encode() for u in row if u != t] for row in IDENTITY_TERMS for t in row}
_TERM = re.compile(rb"(?<![0-9a-z\x80-\xff])(?:" + b"|".join(sorted(map(re.escape, _TERMS), key=len, reverse=True)) + rb")(?![0-9a-z\x80-\xff])")


def swaps(text: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(sentence, sentence with a term swapped) for each identity term of each sentence and each other term of its group.

    All places of the term in the sentence are swapped. Letters A-Z count as lower case.
    """
    text = text.lower()
    if not _TERM.search(text):
        return
    for sentence in _SENTENCE.split(text):
        for term in dict.fromkeys(_TERM.findall(sentence)):
            for other in _TERMS[term]:
                yield sentence, _TERM.sub(lambda m, term=term, other=other: other if m.group() == term else m.group(), sentence)


@dataclass(frozen=True)
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float

    def score(self, words: np.ndarray) -> float:
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        z = self.bias + float(self.weights[at[self.words[at] == words]].sum()) if len(self.words) else self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


#: A swap's change of a sentence's words: those that go, those that come, and how many swaps change the same.
Change = tuple[tuple[int, ...], tuple[int, ...], int]


def selected(row: np.ndarray, col: np.ndarray, toxic: np.ndarray, balance: np.ndarray, width: int) -> np.ndarray:
    """Which words a fit with the lasso gives a weight, by accelerated proximal steps over standardised words."""
    n = len(toxic)
    share = np.bincount(col, minlength=width) / n
    scale = np.sqrt(share * (1 - share)) + 1e-3

    def logits(v: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=(v / scale)[col], minlength=n) - (v / scale) @ share

    def back(error: np.ndarray) -> np.ndarray:
        return (np.bincount(col, weights=error[row], minlength=width) - share * error.sum()) / scale

    v, curve = np.random.Generator(np.random.PCG64(3)).normal(size=width), 1.0
    for _ in range(15):
        v = back(balance * logits(v)) / n
        curve = max(float(np.linalg.norm(v)), 1e-9)
        v /= curve
    step, rate = 1 / (0.275 * curve + 0.25), toxic.mean()
    w, b, t = np.zeros(width), float(np.log(rate / (1 - rate))), 1.0
    ahead, ahead_b = w, b
    for _ in range(LASSO_STEPS):
        error = (1 / (1 + np.exp(-np.clip(ahead_b + logits(ahead), -40, 40))) - toxic) * balance
        moved = ahead - step * back(error) / n
        moved, moved_b = np.sign(moved) * np.maximum(np.abs(moved) - step * LASSO, 0), ahead_b - step * error.mean()
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_b = moved + (t - 1) / after * (moved - w), moved_b + (t - 1) / after * (moved_b - b)
        w, b, t = moved, moved_b, after
    return np.flatnonzero(w)


def fit(words: np.ndarray, texts: list[np.ndarray], toxic: np.ndarray, changes: list[Change], penalty: float = SWAP_PENALTY) -> Model:
    """From sorted word hashes, each text's places in them, its label, and what swaps change: a selection and a fit.

    Without rows of both labels all scores are one rate.
    """
    toxic = np.asarray(toxic, float)
    if not len(texts) or toxic.min() == toxic.max():
        rate = (toxic.sum() + 0.5) / (len(texts) + 1.0) if len(texts) else 0.05
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(rate / (1 - rate))))
    row, col = np.repeat(np.arange(len(texts)), [len(t) for t in texts]), np.concatenate(texts).astype(np.int64)
    # each swap as a sparse row: 1 for a word that comes, -1 for one that goes
    swap = np.repeat(np.arange(len(changes)), [len(gone) + len(new) for gone, new, _ in changes])
    word = np.array([w for gone, new, _ in changes for w in (*gone, *new)], np.int64)
    sign = np.array([v for gone, new, _ in changes for v in (*[-1.0] * len(gone), *[1.0] * len(new))])
    times = np.array([n for *_, n in changes], float)

    rate = toxic.mean()
    balance = np.where(toxic > 0, 0.5 / rate, 0.5 / (1 - rate))
    balance /= balance.mean()
    # the words that count: those of the lasso, and those that swaps change
    use = np.union1d(selected(row, col, toxic, balance, len(words)), word).astype(np.int64)
    place = np.full(len(words), -1)
    place[use] = np.arange(len(use))
    words, word, row, col = words[use], place[word], row[place[col] >= 0], place[col[place[col] >= 0]]
    w, b, n = np.zeros(len(words)), float(np.log(rate / (1 - rate))), len(texts)
    moment, second_moment = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    for step in range(1, STEPS + 1):
        z = b + np.bincount(row, weights=w[col], minlength=n)
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        error = (p - toxic) * balance
        grad = np.bincount(col, weights=error[row], minlength=len(words)) + RIDGE * w
        if len(word):
            moved = np.bincount(swap, weights=sign * w[word], minlength=len(changes))
            grad += np.bincount(word, weights=penalty * (times * moved)[swap] * sign, minlength=len(words))
        grad = np.append(grad, error.sum()) / n
        moment = 0.9 * moment + 0.1 * grad
        second_moment = 0.999 * second_moment + 0.001 * grad**2
        update = RATE * (moment / (1 - 0.9**step)) / (np.sqrt(second_moment / (1 - 0.999**step)) + 1e-8)
        w, b = w - update[:-1], b - update[-1]
    return Model(words, w, float(b))


def vocabulary(words: np.ndarray, seen: np.ndarray, bad: np.ndarray, rate: float) -> np.ndarray:
    """The sorted words of the classifier, from the texts and the toxic texts that have each."""
    chi2 = (bad - seen * rate) ** 2 / (seen * rate * (1 - rate) + 1e-9)
    order = np.lexsort((words, -chi2))
    return np.sort(words[order[seen[order] >= LEAST_TEXTS][:WORDS]])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, texts, toxic texts) of each batch of sampled rows."""
    for batch in batches:
        label = batch.column(0).to_numpy()
        every = [(words, np.full(len(words), label[i])) for i, words in _words(raw(batch.column(1)))]
        found, which = np.unique(np.concatenate([np.zeros(0, np.uint64), *(w for w, _ in every)]), return_inverse=True)
        bad = np.bincount(which, weights=np.concatenate([np.zeros(0), *(x for _, x in every)]), minlength=len(found))
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.bincount(which, minlength=len(found))), pa.array(bad.astype(np.int64))], names=["word", "seen", "bad"])


_PLACE = np.uint16


def _places(texts: list[bytes], words: np.ndarray) -> list[np.ndarray]:
    out = [np.zeros(0, _PLACE)] * len(texts)
    for i, found in _words(texts):
        at = np.minimum(np.searchsorted(words, found), len(words) - 1) if len(words) else found[:0].astype(np.int64)
        out[i] = at[words[at] == found[: len(at)]].astype(_PLACE)
    return out


def text_changes(texts: list[bytes], words: np.ndarray) -> list[Change]:
    """What the swaps in some texts change, equal changes added up."""
    pairs = [pair for t in texts for pair in swaps(t)]
    count: dict[tuple, int] = {}
    sets = [set(x.tolist()) for x in _places([x for pair in pairs for x in pair], words)]
    for before, after in zip(sets[::2], sets[1::2], strict=True):
        if before != after:
            key = (tuple(sorted(before - after)), tuple(sorted(after - before)))
            count[key] = count.get(key, 0) + 1
    return [(*key, n) for key, n in count.items()]


_FEATURES = "label int, words binary, gone array<int>, new array<int>, times long"


def _features(batches: Iterator[pa.RecordBatch], words: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each text with its places in the vocabulary, and a row for each kind of change of the batch's swaps."""
    schema = pa.schema([("label", pa.int32()), ("words", pa.binary()), ("gone", pa.list_(pa.int32())), ("new", pa.list_(pa.int32())), ("times", pa.int64())])
    for batch in batches:
        texts = raw(batch.column(1))
        rows = [{"label": label, "words": x.tobytes()} for label, x in zip(batch.column(0).to_pylist(), _places(texts, words), strict=True)]
        rows += [{"gone": gone, "new": new, "times": n} for gone, new, n in text_changes(texts, words)]
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = np.full(batch.num_rows, model.score(np.zeros(0, np.uint64)))
        for i, words in _words(raw(batch.column(1))):
            score[i] = model.score(words)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id, 3) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, penalty: float = SWAP_PENALTY) -> Model:
    """Fit on SAMPLE labelled rows at most, chosen by a hash of the id; held-out rows are never read.

    An id that is labelled more than once counts as toxic if any label says so; null ids and labels are left out.
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_label")).where(F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & ~held_out(F.col("_id")))
    known = known.groupBy("_id").agg(F.max("_label").alias("_label"))
    some = [known.where(F.col("_label") == label).orderBy(F.xxhash64("_id"), "_id").limit(n) for label, n in zip((1, 0), SAMPLE, strict=True)]
    # at most sum(SAMPLE) rows of 12 bytes
    sample = F.broadcast(some[0].union(some[1]))
    rows = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").alias("_text")).join(sample, F.col("_doc") == F.col("_id")).select("_label", "_text")
    size = rows.agg(F.count("*").alias("n"), F.sum("_label").alias("bad")).head()
    counts = rows.mapInArrow(_counted, "word long, seen long, bad long").groupBy("word").agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad")).where(F.col("seen") >= LEAST_TEXTS)
    rate = (size["bad"] or 0) / max(1, size["n"])
    chi2 = F.pow(F.col("bad") - F.col("seen") * rate, 2) / (F.col("seen") * (rate * (1 - rate)) + 1e-9)
    # at most WORDS rows of 24 bytes, and the terms that swaps name
    top = counts.orderBy(chi2.desc(), "word").limit(WORDS).toArrow()
    words = vocabulary(*(top.column(c).to_numpy().view(t) for c, t in (("word", np.uint64), ("seen", np.int64), ("bad", np.int64))), rate)
    # at most sum(SAMPLE) texts of WORDS places of two bytes, and a few rows for each pair of terms and batch
    got = rows.mapInArrow(partial(_features, words=words), _FEATURES).toArrow().to_pylist()
    texts = sorted(((r["label"], r["words"]) for r in got if r["times"] is None))
    changes: dict[tuple, int] = {}
    for r in got:
        if r["times"] is not None:
            key = (tuple(r["gone"]), tuple(r["new"]))
            changes[key] = changes.get(key, 0) + r["times"]
    return fit(words, [np.frombuffer(x, _PLACE) for _, x in texts], np.array([label for label, _ in texts], float), [(*key, n) for key, n in sorted(changes.items())], penalty)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each input row: doc_id, held_out, score, predicted.

    Only the text is an input of a score; null and empty texts get the classifier's base rate. Rows with a null id are
    scored and not held out. Repeated rows are each scored. Empty tables give no rows; without labels of both kinds
    every score is one rate. Other columns are ignored.
    """
    model = train(docs, labels)
    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(partial(_score, model=model), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that the classifier does not reject, with the columns of ``docs``.

    Each row is decided by its own text: repeated rows alike, null ids like others; null and empty texts by the base
    rate, which stays below the threshold unless most labels are toxic. Empty tables give no rows.
    """
    model = train(docs, labels)
    return docs.where(_probability(model)(F.col("text")) < threshold)


def _probability(model: Model):
    @F.arrow_udf("double")
    def probability(texts: pa.Array) -> pa.Array:
        score = np.full(len(texts), model.score(np.zeros(0, np.uint64)))
        for i, words in _words(raw(texts)):
            score[i] = model.score(words)
        return pa.array(score)

    return probability
