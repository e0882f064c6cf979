"""What the training-data operators share: white space, column picking, Arrow batches and vectorised word hashes."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the operators' contracts define it.
WS = r"[\x20\x09-\x0D]"
NOT_WS = r"[^\x20\x09-\x0D]"

#: Documents in one Arrow batch.
BATCH_DOCS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of maximal runs without ASCII white space."""
    trimmed = F.btrim(text, F.lit("\x20\x09\x0a\x0b\x0c\x0d"))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, f"{WS}+", -1))).cast("long")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids have no remainder."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


#: Rows of ids and keys, of some 24 bytes each, that are broadcast at most.
BROADCAST_ROWS = 1 << 20


def beside(marks: DataFrame) -> DataFrame:
    """A table of ids and keys as a join's side: broadcast up to BROADCAST_ROWS rows, shuffled beyond."""
    return F.broadcast(marks) if marks.count() <= BROADCAST_ROWS else marks


def small_batches(spark: SparkSession) -> None:
    """Bound the documents of one Arrow batch, for this session; its bytes are bounded by Spark's own 64 MB a batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_DOCS))


def raw(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


# --- memory of Python workers --------------------------------------------------------------------------------------

#: What operators keep in a worker between their tasks: functions that give it up.
_kept: list[Callable[[], None]] = []
_malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def keeps(forget: Callable[[], None]) -> None:
    """Tell what gives up what the caller's tasks keep for each other, for when the worker turns to other tasks."""
    _kept.append(forget)


def trim() -> None:
    """Give memory that is free in this process back to the system; allocators hold it else as long as the worker lives."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim is not None:
        _malloc_trim(0)


def lean(task: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A task of mapInArrow that finds and leaves its worker small.

    Spark uses a worker again for other stages, so what one stage holds there counts in all later ones: what other
    operators keep is given up before the task, and free memory after it.
    """

    @wraps(task)
    def run(batches: Iterator[pa.RecordBatch], *args, **kwargs) -> Iterator[pa.RecordBatch]:
        for forget in _kept:
            forget()
        trim()
        try:
            yield from task(batches, *args, **kwargs)
        finally:
            trim()

    return run


# --- vectorised hashes ---------------------------------------------------------------------------------------------

_rng = np.random.Generator(np.random.PCG64(20_240_607))
#: Odd multipliers, one for each place in a shingle.
_PLACES = _rng.integers(1, 2**62, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Words of at most so many bytes are hashed by lanes of 8; longer ones by blake2b.
LANES = 4
_SALTS = _rng.integers(1, 2**63, 8 * LANES + 1, dtype=np.uint64)
#: What of a lane belongs to a word that has so many bytes of it.
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Everything that is no ASCII letter or digit and no byte of a multi-byte character.
NON_LETTERS = np.ones(256, bool)
NON_LETTERS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

#: Bytes hashed at once; longer texts go through in pieces that end at white space.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _lanes(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``buf`` on as one number; zeros follow the last byte."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes; equal spans have equal hashes in every process.

    Each lane goes through a non-linear step, so no pattern of bytes makes different spans meet but by chance. Where
    even chance must not decide, ``distinct_spans`` compares the bytes.
    """
    lanes, length = _lanes(buf), ends - starts
    hashes = mix((lanes[starts] & _KEEP[np.minimum(length, 8)]) ^ _SALTS[np.minimum(length, 8 * LANES)])
    live = np.flatnonzero(length > 8)
    for k in range(1, LANES):
        if not len(live):
            break
        lane = lanes[starts[live] + 8 * k] & _KEEP[np.minimum(length[live] - 8 * k, 8)]
        hashes[live] = mix(hashes[live] + mix(lane ^ _SALTS[k]) * _PLACES[k])
        live = live[length[live] > 8 * (k + 1)]
    for i in live.tolist():
        hashes[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return hashes


def distinct_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, which): a span of each distinct content, and for each span the number of its content.

    Found by hash, then every span is compared byte for byte with the one that stands for it.
    """
    _, first, which = np.unique(hash_spans(buf, starts, ends), return_index=True, return_inverse=True)
    lanes, length, model = _lanes(buf), ends - starts, starts[first][which]
    same = length == length[first][which]
    live = np.flatnonzero(same)
    for k in range(LANES):
        keep = _KEEP[np.minimum(length[live] - 8 * k, 8)]
        same[live] = (lanes[starts[live] + 8 * k] & keep) == (lanes[model[live] + 8 * k] & keep)
        live = live[same[live] & (length[live] > 8 * (k + 1))]
        if not len(live):
            break
    for i in live.tolist():
        same[i] = np.array_equal(buf[starts[i] : ends[i]], buf[model[i] : model[i] + length[i]])
    if same.all():
        return first, which
    number: dict[bytes, int] = {}
    data = buf.tobytes()
    which = np.array([number.setdefault(data[a:b], len(number)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
    return np.unique(which, return_index=True)[1], which


def word_spans(data: bytes, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of one piece."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~separators[np.frombuffer(data, np.uint8)]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _hash_words(data: bytes, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of one piece."""
    starts, ends = word_spans(data, separators)
    return starts, ends, hash_spans(np.frombuffer(data, np.uint8), starts, ends)


def _word_groups(texts: list[bytes], separators: np.ndarray) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(rows, cuts, hashes): the words of some texts in one array, text k having those from cuts[k] to cuts[k + 1]."""
    group: list[int] = []
    size = 0

    def hashed() -> tuple[list[int], np.ndarray, np.ndarray]:
        starts, _, hashes = _hash_words(b"\n".join(texts[i] for i in group), separators)
        return group, np.searchsorted(starts, np.cumsum([0, *(len(texts[i]) + 1 for i in group)])), hashes

    for i, t in enumerate(texts):
        if len(t) > PIECE:
            hashes = np.concatenate([_hash_words(p, separators)[2] for p in _pieces(t, separators)])
            yield [i], np.array([0, len(hashes)]), hashes
            continue
        if group and size + len(t) > PIECE:
            yield hashed()
            group, size = [], 0
        group.append(i)
        size += len(t) + 1
    if group:
        yield hashed()


def word_hashes(texts: list[bytes], separators: np.ndarray = SPACES) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its words in order) for each text. Equal words have equal hashes in every process."""
    for rows, cuts, hashes in _word_groups(texts, separators):
        for k, i in enumerate(rows):
            yield i, hashes[cuts[k] : cuts[k + 1]]


def _pieces(text: bytes, separators: np.ndarray) -> Iterator[bytes]:
    """Cut a very long text where a separator follows."""
    begin = 0
    while begin < len(text):
        end = min(len(text), begin + PIECE)
        while end < len(text) and not separators[text[end]]:
            end += 1
        yield text[begin:end]
        begin = end


def _windows(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of so many words."""
    n = len(words) - width + 1
    total = np.full(n, width, np.uint64)
    for j in range(width):
        total += words[j : j + n] * _PLACES[j + 1]
    return mix(total)


def gram_sets(texts: list[bytes], width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its word windows) for each text.

    A shorter text is one window; a text without words has none.
    """
    for rows, cuts, hashes in _word_groups(texts, SPACES):
        every = _windows(hashes, width) if len(hashes) >= width else hashes[:0]
        for k, i in enumerate(rows):
            lo, hi = cuts[k], cuts[k + 1]
            if hi - lo >= width:
                grams = np.sort(every[lo : hi - width + 1])
                new = np.ones(len(grams), bool)
                np.not_equal(grams[1:], grams[:-1], out=new[1:])
                yield i, grams[new]
            else:
                yield i, _windows(hashes[lo:hi], int(hi - lo)) if hi > lo else hashes[:0]
