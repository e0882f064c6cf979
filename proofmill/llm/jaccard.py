"""Exact Jaccard join of documents as sets of word n-grams, with set relations used to skip work.

A set's n-grams stand in one global order, frequent ones last. Sets that are similar enough share an n-gram in their
prefixes, so an inverted index over prefixes finds them. Three relations between sets save the rest:

* equal sets are one entry of the index;
* an entry says where in its set the n-gram stands, so blocks of a list whose position leaves too few n-grams for a
  partner of the given size are skipped;
* the first pass compares the sets of a list only with its hub, the set that has the fewest rare n-grams. A set that is
  similar to hubs takes the most linked of them as its home, and keeps how it differs from it. The answers of two sets of
  one home then follow from these differences: with d n-grams of difference from the home each, and c of them in common,
  two sets differ in d1 + d2 - 2 c n-grams. Where d1 + d2 is small enough they are linked whatever c is, and sums over
  the sizes of differences count such links without a look at any pair; else the differences are compared, not the sets.

Sets of different homes are compared in a second pass, each pair that shares an n-gram of its prefixes and passes the
position test. So no link is lost: each is one of a set and a hub, of two sets of one home, or of that second pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofmill.llm.common import beside, gram_sets, lean, mix, raw, small_batches, text_or_empty, trim
from proofmill.session import partitions, stored

WORDS = 5
#: So many of the most frequent n-grams stand last in the order, by frequency. The choice is one of speed alone.
FREQUENT = 1 << 18
#: n-grams that one count is made from, and entries of one run of the index.
COUNTED, RUN = 2_500_000, 1_200_000
#: Bits of the largest Bloom filter of set ids, and bytes of its blocks.
FILTER, BLOCK = 1 << 25, 1 << 13
#: Linked: 7 * intersection >= 3 * (size + size), which is 100 * intersection >= 75 * union.
NUM, DEN = 3, 7


#: A set's id is a digest of 16 bytes.
_ID = "S16"


def _set_id(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), _ID)


def _binary(ids: np.ndarray) -> pa.Array:
    """An Arrow column of ids; zero bytes at their ends stay."""
    data = np.ascontiguousarray(ids).tobytes()
    return pa.array([data[i : i + 16] for i in range(0, len(data), 16)], pa.binary())


def _sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted n-gram hashes) for each text; letters A-Z count as lower case."""
    return gram_sets([t.lower() for t in raw(column)], WORDS)


def _sketch(grams: np.ndarray) -> bytes:
    """Parities of the n-grams dealt over about twice as many bits, a power of two.

    Sets differ in as many n-grams at least as their sketches differ in bits: each n-gram changes one.
    """
    size = 1 << max(6, int(2 * len(grams) - 1).bit_length())
    return np.packbits((np.bincount((grams & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(bool)).tobytes()


def _may_link(n1: int, sketch1: bytes, n2: int, sketch2: bytes) -> bool:
    """Whether the sketches differ in no more bits than linked sets may in n-grams; the larger one is folded first."""
    x, y = np.frombuffer(sketch1, np.uint8), np.frombuffer(sketch2, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) * DEN <= n1 + n2


def repeated(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values that occur twice at least, ascending, and how often; sorts ``values`` in place and needs little beside it."""
    values.sort()
    same = np.zeros(len(values) + 1, bool)
    np.equal(values[1:], values[:-1], out=same[1:-1])
    first, last = np.flatnonzero(same[1:] & ~same[:-1]), np.flatnonzero(same[:-1] & ~same[1:])
    return values[first], last - first + 1


_PROFILE = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int64()), ("set_id", pa.binary()), ("sketch", pa.binary()), ("gram", pa.int64()), ("times", pa.int64())])


@lean
def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and rows for n-grams that several sets of a run have."""
    run: dict[bytes, np.ndarray] = {}
    held = 0

    def counted() -> pa.RecordBatch:
        every = np.concatenate([*run.values(), np.zeros(0, np.uint64)])
        run.clear()
        grams, times = repeated(every)
        none = pa.nulls(len(grams), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(grams), pa.binary()), pa.nulls(len(grams), pa.binary()), pa.array(grams.view(np.int64)), pa.array(times.astype(np.int64))], schema=_PROFILE)

    for batch in batches:
        n, ids, sketches = [0] * batch.num_rows, [b""] * batch.num_rows, [b""] * batch.num_rows
        for i, grams in _sets(batch.column(2)):
            n[i], ids[i], sketches[i] = len(grams), _set_id(grams), _sketch(grams)
            if len(grams) and ids[i] not in run:
                run[ids[i]] = grams
                held += len(grams)
        none = pa.nulls(batch.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(sketches, pa.binary()), none, none], schema=_PROFILE)
        if held > COUNTED:
            yield counted()
            held = 0
    if run:
        yield counted()


#: What a run sends to a bucket: an entry has half a hash and a place; what belongs to the set is there once, with its number of entries.
_RUNS = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("gram", "set_id", "n", "pos", "rare", "times"))])
#: A bucket's lists: for each entry the n-gram, its place and the number of the set; for each set its id and sizes.
_LISTS = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("gram", "owner", "pos", "set_id", "n", "rare"))])
_TYPES = {"gram": np.uint32, "owner": np.uint32, "pos": np.uint32, "set_id": _ID, "n": np.uint32, "rare": np.uint32}


@lean
def _index(batches: Iterator[pa.RecordBatch], frequent: np.ndarray, rank: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Index entries of the prefixes, in one row for each run and bucket of n-grams."""
    seen: set[bytes] = set()
    entries: list[tuple[np.ndarray, bytes, int, int]] = []
    held = 0

    def dealt() -> pa.RecordBatch:
        gram = np.concatenate([e[0] for e in entries])
        lengths = np.array([len(e[0]) for e in entries])
        owner = np.repeat(np.arange(len(entries), dtype=np.uint32), lengths)
        pos = np.arange(len(gram), dtype=np.uint32) - np.repeat((np.cumsum(lengths) - lengths).astype(np.uint32), lengths)
        ids, n, rare = (np.array([e[k] for e in entries], kind) for k, kind in ((1, _ID), (2, np.uint32), (3, np.uint32)))
        entries.clear()
        bucket = (mix(gram) % np.uint64(buckets)).astype(np.int32)
        gram = (gram >> np.uint64(32)).astype(np.uint32)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        cuts = _bounds(bucket)
        rows = []
        for name, lo, hi in zip(bucket[cuts[:-1]].tolist(), cuts, cuts[1:], strict=False):
            at = order[lo:hi]
            owners, times = np.unique(owner[at], return_counts=True)
            wide = np.uint16 if pos[at].max() < 1 << 16 else np.uint32
            parts = (gram[at], ids[owners], n[owners], pos[at].astype(wide), rare[owners], times.astype(np.uint32))
            rows.append((name, *(x.tobytes() for x in parts)))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RUNS, strict=True)], schema=_RUNS)

    for batch in batches:
        for _, grams in _sets(batch.column(0)):
            if not len(grams) or (sid := _set_id(grams)) in seen:
                continue
            seen.add(sid)
            at = np.minimum(np.searchsorted(frequent, grams), max(0, len(frequent) - 1))
            often = frequent[at] == grams if len(frequent) else np.zeros(len(grams), bool)
            n, rare = len(grams), int(len(grams) - often.sum())
            prefix = n - (NUM * n + NUM) // (NUM + 1) + 1
            first = grams[np.flatnonzero(~often)[:prefix]]
            if len(first) < prefix:
                last = grams[often][np.argsort(rank[at[often]], kind="stable")]
                first = np.concatenate([first, last[: prefix - len(first)]])
            entries.append((first, sid, n, rare))
            held += len(first)
        if held > RUN:
            yield dealt()
            held = 0
        if len(seen) > 1_000_000:
            seen.clear()
    if entries:
        yield dealt()


def _load(batch: pa.RecordBatch | pa.Table) -> dict[str, np.ndarray]:
    """The arrays of one bucket; n and rare for each entry, ``ids`` for each set."""
    c = {name: np.frombuffer(batch.column(name).to_pylist()[0], kind) for name, kind in _TYPES.items()}
    return c | {"ids": c["set_id"], "n": c["n"][c["owner"]].astype(np.int64), "rare": c["rare"][c["owner"]], "pos": c["pos"].astype(np.int64)}


def _lists(key: tuple, table: pa.Table) -> pa.Table:
    """The lists of a bucket that have two sets at least, ordered by n-gram and then by size.

    n-grams of equal half hashes share a list, which only adds pairs to compare; a set is in it at its first place.
    """
    rows = table.to_pylist()
    gram = np.concatenate([np.frombuffer(r["gram"], np.uint32) for r in rows])
    pos = np.concatenate([np.frombuffer(r["pos"], np.uint16 if 2 * len(r["pos"]) == len(r["gram"]) else np.uint32).astype(np.uint32) for r in rows])
    ids, n, rare, times = (np.concatenate([np.frombuffer(r[k], kind) for r in rows]) for k, kind in (("set_id", _ID), ("n", np.uint32), ("rare", np.uint32), ("times", np.uint32)))
    del rows
    ids, first, number = np.unique(ids, return_index=True, return_inverse=True)
    n, rare, owner = n[first], rare[first], np.repeat(number.astype(np.uint32), times)
    order = np.lexsort((pos, owner, n[owner], gram))
    gram, pos, owner = gram[order], pos[order], owner[order]
    del order
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    gram, pos, owner = gram[new], pos[new], owner[new]
    # entries whose n-gram the one before or after has too
    same = np.zeros(len(gram) + 1, bool)
    np.equal(gram[1:], gram[:-1], out=same[1:-1])
    keep = same[1:] | same[:-1]
    gram, pos, owner = gram[keep], pos[keep], owner[keep]
    present = np.zeros(len(ids), bool)
    present[owner] = True
    owner = (np.cumsum(present) - 1).astype(np.uint32)[owner]
    arrays = (gram, owner, pos, ids[present], n[present], rare[present])
    found = _LISTS.empty_table()
    if len(gram):
        found = pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in arrays)], schema=_LISTS)
    del gram, pos, owner, new, same, keep, arrays
    trim()
    return found


def _bounds(gram: np.ndarray) -> list[int]:
    return [0, *(np.flatnonzero(gram[1:] != gram[:-1]) + 1).tolist(), len(gram)]


def _possible(n1, left1, n2, left2):
    """Whether sets of these sizes can be linked, with so many n-grams from their first common one on."""
    least = (NUM * (n1 + n2) + DEN - 1) // DEN
    return (left1 >= least) & (left2 >= least) & ((NUM + 1) * np.minimum(n1, n2) >= NUM * np.maximum(n1, n2))


_PAIRS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _distinct_pairs(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of set numbers."""
    none = np.zeros(0, np.int64)
    both = np.unique(np.concatenate([none, *a]).astype(np.int64) << 32 | np.concatenate([none, *b]).astype(np.int64))
    return both >> 32, both & 0xFFFFFFFF


def _hubs(c: dict[str, np.ndarray], cuts: list[int]) -> np.ndarray:
    """For each list, the place of the set with the smallest part of rare n-grams."""
    number = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    order = np.lexsort((c["owner"], c["rare"].astype(np.int64) * (1 << 24) // c["n"], number))
    return order[np.array(cuts[:-1], np.int64)]


@lean
def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (hub, other) of each list that may be linked."""
    for batch in batches:
        for row in range(batch.num_rows):
            c = _load(batch.slice(row, 1))
            cuts = _bounds(c["gram"])
            hub = np.repeat(_hubs(c, cuts), np.diff(cuts))
            n, left = c["n"], c["n"] - c["pos"]
            ok = (hub != np.arange(len(hub))) & _possible(n[hub], left[hub], n, left)
            a, b = _distinct_pairs([c["owner"][hub[ok]]], [c["owner"][ok]])
            yield pa.RecordBatch.from_arrays([_binary(c["ids"][a]), _binary(c["ids"][b])], schema=_PAIRS)


def _unconnected(key: tuple, lists: pa.Table, labels: pa.Table) -> pa.Table:
    """Pairs of a bucket's lists that may be linked and have different labels; a set without one is its own label."""
    if not lists.num_rows:
        return _PAIRS.empty_table()
    c = _load(lists)
    ids, known = c["ids"], _ids(labels.column("set_id"))
    label = ids.copy()
    if len(known):
        order = np.argsort(known)
        at = np.minimum(np.searchsorted(known[order], ids), len(known) - 1)
        label = np.where(known[order][at] == ids, _ids(labels.column("label"))[order][at], label)
    group = np.unique(label, return_inverse=True)[1][c["owner"]]
    cuts = _bounds(c["gram"])
    hubs = _hubs(c, cuts)
    n, left, owner = c["n"], c["n"] - c["pos"], c["owner"]
    out_a, out_b, held = [], [], 0
    for k in range(len(cuts) - 1):
        lo, hi = cuts[k], cuts[k + 1]
        if hi - lo < 3:
            continue  # the first pass had this pair
        g = group[lo:hi]
        names, counts = np.unique(g, return_counts=True)
        if len(names) == 1:
            continue
        rows = np.flatnonzero((g != names[np.argmax(counts)]) & (np.arange(lo, hi) != hubs[k]))
        size, rest, who = n[lo:hi], left[lo:hi], owner[lo:hi]
        # a list is ordered by size: partners lie in one block, which position and size bound
        begin = np.searchsorted(size, (NUM * size[rows] + NUM) // (NUM + 1))
        end = np.searchsorted(size, np.minimum(((NUM + 1) * size[rows]) // NUM, (DEN * rest[rows]) // NUM - size[rows]), side="right")
        for r, s, e in zip(rows[end > begin], begin[end > begin], end[end > begin], strict=True):
            ok = (g[s:e] != g[r]) & _possible(size[r], rest[r], size[s:e], rest[s:e])
            if hits := int(ok.sum()):
                out_a.append(np.minimum(who[r], who[s:e][ok]))
                out_b.append(np.maximum(who[r], who[s:e][ok]))
                held += hits
        if held > RUN:
            a, b = _distinct_pairs(out_a, out_b)
            out_a, out_b, held = [a], [b], 0
    a, b = _distinct_pairs(out_a, out_b)
    x, y = ids[a], ids[b]
    return pa.Table.from_arrays([_binary(np.where(x < y, x, y)), _binary(np.where(x < y, y, x))], schema=_PAIRS)


def _bits(ids: np.ndarray, size: int) -> np.ndarray:
    """The places of ids in a Bloom filter of so many bits, one row for each of its hashes."""
    half = ids.view("<u8")[::2]
    return np.stack([mix(half + np.uint64(k)) % np.uint64(size) for k in range(1, 5)])


@lean
def _filter_part(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(size, bool)
    some = False
    for batch in batches:
        for column in batch.columns:
            bits[_bits(_ids(column), size).ravel()] = True
            some = True
    if some:
        blocks = np.packbits(bits).reshape(-1, BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks), dtype=np.int32)), pa.array([x.tobytes() for x in blocks], pa.binary())], names=["block", "bits"])


@lean
def _filter_union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blocks: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(bits, np.uint8)
            blocks[block] = blocks[block] | x if block in blocks else x
    if blocks:
        yield pa.RecordBatch.from_arrays([pa.array([*blocks], pa.int32()), pa.array([x.tobytes() for x in blocks.values()], pa.binary())], names=["block", "bits"])


def _passes(ids: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Which ids a filter, packed into bytes, lets pass."""
    at = _bits(ids, 8 * len(packed))
    return ((packed[at >> np.uint64(3)] >> (7 - (at & np.uint64(7)))) & np.uint64(1)).all(axis=0)


def _filter(ids: DataFrame, least: int) -> np.ndarray:
    """A Bloom filter of the ids in all columns, of ``least`` bits if that is not above FILTER, packed into bytes."""
    size = 1 << 16
    while size < min(FILTER, least):
        size *= 2
    schema = "block int, bits binary"
    parts = ids.mapInArrow(partial(_filter_part, size=size), schema).repartition(partitions(ids.sparkSession), "block").mapInArrow(_filter_union, schema).toArrow()
    blocks = np.zeros((size // 8 // BLOCK, BLOCK), np.uint8)
    for block, bits in zip(parts.column("block").to_pylist(), parts.column("bits").to_pylist(), strict=True):
        blocks[block] = np.frombuffer(bits, np.uint8)
    return blocks.ravel()


@lean
def _bucket_sets(batches: Iterator[pa.RecordBatch], linked: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(bucket, set_id) for the linked sets in lists of three at least; the first pass has compared the two of shorter ones."""
    for batch in batches:
        for row in range(batch.num_rows):
            c = _load(batch.slice(row, 1))
            _, where, count = np.unique(c["gram"], return_inverse=True, return_counts=True)
            ids = c["ids"][np.unique(c["owner"][count[where] > 2])]
            ids = ids[_passes(ids, linked)]
            yield pa.RecordBatch.from_arrays([pa.array([batch.column("bucket")[row].as_py()] * len(ids), pa.int32()), _binary(ids)], names=["bucket", "set_id"])


@lean
def _gram_rows(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(set_id, n-grams) of the sets that the filter lets pass."""
    seen: set[bytes] = set()
    for batch in batches:
        ids, grams = [], []
        for _, g in _sets(batch.column(0)):
            sid = _set_id(g)
            if sid not in seen and _passes(np.array([sid], _ID), wanted)[0]:
                seen.add(sid)
                ids.append(sid)
                grams.append(g.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(grams, pa.binary())], names=["set_id", "grams"])


_LINKS = pa.schema([*_PAIRS, ("d", pa.int64()), ("delta", pa.binary())])


@lean
def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that are linked, with the n-grams that one of the two has and the other lacks."""
    for batch in batches:
        deltas = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            delta = np.setxor1d(x, y, assume_unique=True)
            # DEN * intersection >= NUM * (size + size), the intersection being half of what is no difference
            deltas.append(delta if (DEN - 2 * NUM) * (len(x) + len(y)) >= DEN * len(delta) else None)
        columns = [*batch.columns[:2], pa.array([0 if x is None else len(x) for x in deltas], pa.int64()), pa.array([x if x is None else x.tobytes() for x in deltas], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, schema=_LINKS).filter(pa.array([x is not None for x in deltas], pa.bool_()))


@lean
def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns[2:]]
        yield pa.RecordBatch.from_arrays(batch.columns[:2], schema=_PAIRS).filter(pa.array([_may_link(*row) for row in zip(*columns, strict=True)], pa.bool_()))


def _verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, d, delta): the pairs that are linked, by exact comparison, and the n-grams in which they differ.

    Sketches rule out pairs that cannot be. The n-grams of their sets are made again from the texts; a Bloom filter of FILTER bits at most keeps those of other
    sets from the shuffle, and the joins with the pairs drop what it lets pass by mistake.
    """
    side = lambda name: sets.select(F.col("set_id").alias(name), F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"sketch_{name}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "sketch_a", "n_b", "sketch_b")
    pairs = stored(near.mapInArrow(_sketched, "a binary, b binary"), "near-pairs")
    wanted = _filter(pairs, 32 * pairs.count())
    grams = texts.select("text").mapInArrow(partial(_gram_rows, wanted=wanted), "set_id binary, grams binary").dropDuplicates(["set_id"])
    grams = stored(grams, "grams")
    left = grams.select(F.col("set_id").alias("a"), F.col("grams").alias("grams_a"))
    right = grams.select(F.col("set_id").alias("b"), F.col("grams").alias("grams_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "grams_a", "grams_b").mapInArrow(_compare, "a binary, b binary, d long, delta binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of the edges (a, b); the label is the component's smallest node.

    Large and small stars in turn, each a minimum per node, which is summed up before the shuffle, and a join.
    """
    now, mark = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges"), None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        now = stored(small, "edges")
        was, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if was == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams above the smallest count that at most FREQUENT reach, in order of hash, and their ranks by count."""
    top = 10_000
    total, least = 0, top + 1
    for times, n in sorted(counts.groupBy(F.least("times", F.lit(top)).alias("times")).count().collect(), reverse=True):
        total += n
        if total > FREQUENT:
            break
        least = times
    # FREQUENT rows of 16 bytes at most
    found = counts.where(F.col("times") >= least).toArrow()
    grams, times = found.column("gram").to_numpy().view(np.uint64), found.column("times").to_numpy()
    order = np.argsort(grams)
    rank = np.empty(len(grams), np.int64)
    rank[np.lexsort((grams, times))] = np.arange(len(grams))
    return grams[order], rank[order]


#: Rows of one block of sets of one home whose differences are compared.
SIDE = 1024


def _undecided(key: tuple, rows: pa.Table) -> pa.Table:
    """(set_id, times): links between the sets of two blocks of one home that sizes of differences do not decide.

    Two sets are linked when 14 c >= a1 + a2, a being 7 d - n and c what their differences have in common; pairs with
    a1 + a2 <= 0 are counted elsewhere.
    """
    p, q = key[1].as_py(), key[2].as_py()
    side = rows.column("side").to_numpy()
    a, w, deltas = rows.column("a").to_numpy(), rows.column("w").to_numpy(), rows.column("delta").to_pylist()
    left, right = np.flatnonzero(side == p), np.flatnonzero(side == q)

    def entries(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [np.frombuffer(deltas[i], np.uint64) for i in of]
        who = np.repeat(np.arange(len(of)), [len(x) for x in found])
        gram = np.concatenate([np.zeros(0, np.uint64), *found])
        order = np.argsort(gram, kind="stable")
        return gram[order], who[order]

    common = np.zeros((len(left), len(right)), np.int32)
    (gl, wl), (gr, wr) = entries(left), entries(right)
    shared = np.intersect1d(gl, gr)
    spans = [np.searchsorted(g, shared, side=s) for g in (gl, gr) for s in ("left", "right")]
    for l0, l1, r0, r1 in zip(*(x.tolist() for x in spans), strict=True):
        common[np.ix_(wl[l0:l1], wr[r0:r1])] += 1
    needed = a[left][:, None] + a[right][None, :]
    linked = (needed > 0) & (2 * DEN * common >= needed)
    if p == q:
        np.fill_diagonal(linked, False)
    times = np.zeros(len(a), np.int64)
    times[left] += linked @ w[right]
    if p != q:
        times[right] += w[left] @ linked
    some = np.flatnonzero(times)
    return pa.table({"set_id": rows.column("set_id").combine_chunks().take(pa.array(some)), "times": pa.array(times[some])})


def _links_within(members: DataFrame) -> DataFrame:
    """(set_id, times): for each set the documents of other sets of its home that it is linked with.

    ``members`` has root, set_id, n, w, d and delta: a set's home, size and documents, and its difference from the home.
    Links that the sizes of differences decide are counted from sums per home and size. Other pairs have a member with
    a > 0; such members and those that may be linked with them meet in blocks of some SIDE rows, two blocks a task.
    """
    members = stored(members.withColumn("a", DEN * F.col("d") - (DEN - 2 * NUM) * F.col("n")), "members")
    sums = members.groupBy("root", F.col("a").alias("at")).agg(F.sum("w").alias("w"))
    asked = members.select("root", (-F.col("a")).alias("at")).distinct()
    both = sums.select("root", "at", "w", F.lit(False).alias("asks")).union(asked.select("root", "at", F.lit(0).cast("long"), F.lit(True)))
    # a few rows for each size of difference, however many sets have it
    upto = Window.partitionBy("root").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    reached = both.withColumn("reached", F.sum("w").over(upto)).where("asks").select(F.col("root").alias("_root"), F.col("at").alias("_at"), "reached")
    sure = members.join(reached, (F.col("root") == F.col("_root")) & (F.col("_at") == -F.col("a"))).select("set_id", (F.col("reached") - F.when(F.col("a") <= 0, F.col("w")).otherwise(0)).alias("times"))

    highest = members.groupBy(F.col("root").alias("_root")).agg(F.max("a").alias("_high")).where("_high > 0")
    active = members.join(highest, F.col("root") == F.col("_root")).where(F.col("a") + F.col("_high") > 0)
    active = stored(active.select("root", "set_id", "a", "w", "delta"), "active")
    blocks = active.groupBy(F.col("root").alias("_root")).agg(F.count("*").alias("_count")).where("_count > 1").select("_root", F.ceil(F.col("_count") / SIDE).cast("int").alias("_blocks"))
    dealt = active.join(blocks, F.col("root") == F.col("_root")).withColumn("side", F.pmod(F.xxhash64("set_id"), F.col("_blocks")).cast("int"))
    met = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    met = met.select("root", F.least("side", "_other").alias("p"), F.greatest("side", "_other").alias("q"), "side", "set_id", "a", "w", "delta")
    return sure.union(met.groupBy("root", "p", "q").applyInArrow(_undecided, "set_id binary, times long"))


def _homes(links: DataFrame) -> DataFrame:
    """(set_id, home) for sets with links: of the hubs among a set and those it is linked with, the one with most links."""
    degree = links.groupBy(F.col("a").alias("hub")).agg(F.count("*").alias("degree"))
    ranked = links.join(degree, F.col("a") == F.col("hub")).select(F.col("b").alias("set_id"), "degree", "hub")
    ranked = ranked.union(degree.select(F.col("hub").alias("set_id"), "degree", "hub"))
    return ranked.groupBy("set_id").agg(F.max(F.struct("degree", "hub"))["hub"].alias("home"))


def _counted(sets: DataFrame, links: DataFrame, homes: DataFrame, more: DataFrame) -> DataFrame:
    """(set_id, times): the documents of other sets that each set is linked with, for sets that have any."""
    size = sets.select("set_id", "n", "w")
    roots = homes.where("set_id = home").select("set_id")
    away = homes.where("set_id <> home").select(F.col("home").alias("a"), F.col("set_id").alias("b")).join(links, ["a", "b"]).select(F.col("a").alias("root"), F.col("b").alias("set_id"), "d", "delta")
    at_home = roots.select(F.col("set_id").alias("root"), "set_id", F.lit(0).cast("long").alias("d"), F.lit(b"").alias("delta"))
    within = _links_within(away.union(at_home).join(size, "set_id"))
    side = lambda name: homes.select(F.col("set_id").alias(name), F.col("home").alias(f"home_{name}"))
    apart = links.select("a", "b").join(side("a"), "a").join(side("b"), "b").where("home_a <> home_b")
    cross = apart.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(more.select("a", "b")).distinct()
    both = cross.select(F.col("a").alias("set_id"), F.col("b").alias("other")).union(cross.select("b", "a"))
    across = both.join(size.select(F.col("set_id").alias("other"), "w"), "other").select("set_id", F.col("w").alias("times"))
    return within.union(across).groupBy("set_id").agg(F.sum("times").alias("times"))


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_links: bool = True) -> DataFrame:
    """One row for each input row: doc_id, n_shingles, component_id, class_id, n_links, and text_key, a hash of the text.

    component_id is the smallest doc_id that links of Jaccard similarity 0.75 or more reach, the row's own included.
    Rows with equal sets are linked and a class: class_id is the smallest doc_id of it. n_links is the number of other
    rows that the row is linked with; it is null without ``count_links``, which leaves out the comparison of sets that
    are connected already. Null and empty texts, and texts of white space, have no n-grams and are linked with nothing.
    Texts under five words are one n-gram. Null ids are never the smallest; a component without other ids has none. Rows
    that repeat are all kept. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    profile = stored(texts.mapInArrow(_profile, "doc_id long, text_key long, n long, set_id binary, sketch binary, gram long, times long"), "profile")
    rows = profile.where("gram is null").select("doc_id", "text_key", "n", "set_id")
    sets = stored(profile.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("w")), "sets")

    frequent, rank = _frequent(stored(profile.where("gram is not null").groupBy("gram").agg(F.sum("times").alias("times")), "gram-counts"))
    columns = ", ".join(f"{f.name} {'int' if f.name == 'bucket' else 'binary'}" for f in _LISTS)
    # a bucket has some RUN entries, so a task's part of the index does not grow with the corpus
    indexed = sets.agg(F.sum(F.floor(F.col("n") / (NUM + 1)) + 1)).head()[0] or 0
    buckets = max(partitions(spark), -(-int(indexed) // RUN))
    entries = texts.select("text").mapInArrow(partial(_index, frequent=frequent, rank=rank, buckets=buckets), "bucket int, gram binary, set_id binary, n binary, pos binary, rare binary, times binary")
    lists = stored(entries.groupBy("bucket").applyInArrow(_lists, columns), "lists")

    stars = stored(lists.mapInArrow(_stars, "a binary, b binary").distinct(), "stars")
    links = stored(_verified(stars, sets, texts), "links")
    labels = _homes(links).select("set_id", F.col("home").alias("label")) if count_links else components(links).select(F.col("node").alias("set_id"), "label")
    labels = stored(labels, "labels")
    linked = _filter(labels.select("set_id"), 16 * labels.count())
    held = lists.select(*_LISTS.names).mapInArrow(partial(_bucket_sets, linked=linked), "bucket int, set_id binary")
    known = held.join(labels, "set_id").select("bucket", "set_id", "label")
    more = lists.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(_unconnected, "a binary, b binary").distinct()
    done = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = stored(_verified(more.join(done, ["a", "b"], "left_anti"), sets, texts).select("a", "b"), "more-links")

    reps = sets.select("set_id", "rep", "w")
    labelled = components(links.select("a", "b").union(more)).select(F.col("node").alias("set_id"), "label")
    smallest = labelled.join(reps, "set_id").groupBy("label").agg(F.min("rep").alias("component_id"))
    found = reps.join(labelled, "set_id", "left").join(smallest, "label", "left").select("set_id", F.coalesce("component_id", "rep").alias("component_id"), F.col("rep").alias("class_id"), "w")
    if count_links:
        times = _counted(sets, links, labels.select("set_id", F.col("label").alias("home")), more)
        found = found.join(times, "set_id", "left").withColumn("n_links", F.col("w") - 1 + F.coalesce("times", F.lit(0)))
    else:
        found = found.withColumn("n_links", F.lit(None).cast("long"))
    columns = ["doc_id", "n_shingles", "component_id", "class_id", "n_links", "text_key"]
    none = F.lit(0 if count_links else None).cast("long").alias("n_links")
    empty = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"), none, "text_key")
    return rows.where("n > 0").join(found, "set_id").withColumnRenamed("n", "n_shingles").select(columns).union(empty)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component of ``jaccard_classes``, the one with the smallest doc_id, with the columns of ``docs``.

    Of rows that repeat both id and text one stays. Rows without words are linked with nothing and stay; so do rows
    with a null id whose component has no other id. An empty table gives no rows.
    """
    classes = jaccard_classes(docs, count_links=False).groupBy(F.col("doc_id").alias("_mark_id"), F.col("text_key").alias("_mark_key"))
    marks = classes.agg(F.bool_and(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("_stays"), F.count("*").alias("_times"))
    # only what goes, and what repeats, is joined with the rows: whole texts are not shuffled for it
    marks = stored(marks.where("not _stays or _times > 1").select("_mark_id", "_mark_key", "_stays"), "marks")
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text_or_empty()).alias("_key"), F.struct("*").alias("_doc"))
    marked = rows.join(beside(marks), F.col("_id").eqNullSafe(F.col("_mark_id")) & (F.col("_key") == F.col("_mark_key")), "left")
    once = marked.where("_stays").dropDuplicates(["_id", "_key"])
    return marked.where("_stays is null").select("_doc.*").union(once.select("_doc.*"))
