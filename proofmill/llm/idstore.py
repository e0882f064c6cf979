"""Token ids in a content-addressed store.

A rolling hash over the last ids cuts each document's id stream into chunks; a chunk is stored once under its digest.
A document is a recipe: the digests and lengths of its chunks. Recipes lie in files by ascending doc_id; a manifest has
a Merkle root per file, and ``root/`` has one over all files; reading back verifies every chunk, recipe and count by them.

File format, below one folder: ``encoded/kind=chunk/`` Parquet (key, data), data being little-endian unsigned integers
of WIDTH bytes and key their digest; ``recipes/part=N/`` Parquet (row, doc_id, n_tokens, start, recipe), start within
the part, rows ascending; the row numbered -1 is the part's manifest: documents, tokens and Merkle root.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.llm.common import PIECE, distinct_spans, keeps, raw, small_batches
from proofmill.session import partitions, shared_path, stored

END_ID = 1
#: Bytes of an id in a chunk: the vocabulary has under 65,536 ids.
WIDTH = 2
#: A chunk ends where the rolling hash of the last WINDOW ids has MASK's bits clear, within LEAST and MOST ids.
WINDOW, MASK, LEAST, MOST = 8, 511, 64, 4096
#: Words of one of a worker's two memories; the older is given up when the younger is full.
REMEMBERED = 700_000
#: Digests of chunks a task remembers to have sent.
SENT = 500_000

_GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 2**32, 1 << 16, dtype=np.uint32)
_ODD = np.array([pow(0x01000193, j, 2**32) for j in range(WINDOW)], np.uint32)
_tokenizers: dict[str, object] = {}
_plain: dict[str, object] = {}
_word_ends: dict[str, np.ndarray] = {}
#: Ids of the words of late and of those before.
_young: dict[bytes, bytes] = {}
_old: dict[bytes, bytes] = {}
#: Bytes of ASCII and of accented Latin-1 letters, and the class of each byte: 0 blank, 1 letter, 2 digit, 3 other mark.
_LATIN_BYTES = bytes([*range(128), 0xC3, *range(0x80, 0xC0)])
_KIND = np.full(256, 3, np.uint8)
_KIND[[*range(97, 123), 0xC3, *range(0x80, 0xC0)]] = 1
_KIND[48:58] = 2
_KIND[[32, *range(9, 14)]] = 0
_LETTERS, _NUMBERS, _BLANKS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
#: Fixed value: the tokenizer's own splitting pattern, with its character classes written out for Latin-1.
LATIN_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_BLANKS}{_LETTERS}{_NUMBERS}]+")


def forget() -> None:
    """Give up the tokenizers and the words that a worker remembers."""
    for kept in (_tokenizers, _plain, _word_ends, _young, _old):
        kept.clear()


keeps(forget)


def _tokenizer(path: str):
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        _tokenizers[path] = tokenizer = Tokenizer.from_file(path)
        ends = np.zeros(1 << (8 * WIDTH), bool)
        ends[[i for piece, i in tokenizer.get_vocab().items() if piece.endswith("</w>")]] = True
        _word_ends[path] = ends
        # for words that are split and lower-cased already: the same merges without normalising and splitting again
        _plain[path] = Tokenizer.from_file(path)
        _plain[path].normalizer = None
        _plain[path].pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return _tokenizers[path]


def _pack(ids: list[int]) -> bytes:
    return np.array(ids, f"<u{WIDTH}").tobytes()


def _library(words: list[str], path: str) -> list[bytes]:
    """The ids of words; each is one that LATIN_WORD finds in lower case."""
    tokenizer, ends = _tokenizer(path), _word_ends[path]
    plain = [w for w in words if w.isalpha()]
    found: dict[str, bytes] = {}
    groups = [plain[k : k + 500] for k in range(0, len(plain), 500)]
    for some, encoded in zip(groups, _plain[path].encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
        # a run of letters is one word to the library, which ends in one piece with a word end
        ids = np.array(encoded.ids, f"<u{WIDTH}")
        cuts = [0, *((np.flatnonzero(ends[ids]) + 1) * WIDTH).tolist()]
        if len(cuts) != len(some) + 1:
            raise ValueError("the tokenizer's words are not runs of letters")
        data = ids.tobytes()
        found.update((w, data[a:b]) for w, a, b in zip(some, cuts, cuts[1:], strict=False))
    other = [w for w in words if not w.isalpha()]
    found.update((w, _pack(e.ids)) for w, e in zip(other, tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True))
    return [found[w] for w in words]


def _plain_text(text: bytes) -> bytes | None:
    """The text in lower case if it is one in which words are runs of bytes of a class; else null.

    That is a text of ASCII and accented Latin-1 letters, without apostrophes, which begin contractions, and without
    what a special token begins with.
    """
    if b"'" in text or b"<|" in text:
        return None
    if text.isascii():
        return text.lower()
    if text.translate(None, _LATIN_BYTES) or b"\xc3\x97" in text or b"\xc3\xb7" in text:
        return None
    try:
        return text.decode("utf-8").lower().encode("utf-8")
    except UnicodeDecodeError:
        return None


def _encode_plain(texts: list[bytes], path: str) -> list[bytes]:
    """Ids of texts that ``_plain_text`` gave. Each distinct word is looked up once."""
    data = b"\n".join(texts)
    buf = np.frombuffer(data, np.uint8)
    kind = np.zeros(len(buf) + 2, np.uint8)
    kind[1:-1] = _KIND[buf]
    change = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    edge = (kind[1:] != kind[:-1]) | (kind[:-1] == 2)
    starts = np.flatnonzero(change[:-1] & (kind[1:-1] != 0))
    ends = np.flatnonzero(edge[1:] & (kind[1:-1] != 0)) + 1
    first, which = distinct_spans(buf, starts, ends)
    keys = [data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    pieces = list(map(_young.get, keys))
    missing = [i for i, p in enumerate(pieces) if p is None]
    new = []
    for i in missing:
        if (p := _old.get(keys[i])) is None:
            new.append(i)
        else:
            pieces[i] = p
    for i, p in zip(new, _library([keys[i].decode() for i in new], path), strict=True):
        pieces[i] = p
    _young.update((keys[i], pieces[i]) for i in missing)
    pool = np.frombuffer(b"".join(pieces), f"<u{WIDTH}")
    size = np.fromiter(map(len, pieces), np.int64, len(pieces)) // WIDTH
    begin = np.cumsum(size) - size
    lengths = size[which]
    after = np.concatenate([[0], np.cumsum(lengths)])
    ids = pool[np.repeat(begin[which] - after[:-1], lengths) + np.arange(after[-1])]
    cuts = after[np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))]
    return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]


def encode_texts(texts: list[bytes], path: str) -> list[bytes]:
    """Each text's ids, WIDTH bytes each, with END_ID appended.

    The tokenizer lower-cases, and splits a text into words by a pattern before any merge, so a text's ids are those of
    its words in order. For texts of Latin-1 characters the same words are found here, by ``_encode_plain`` where bytes
    tell them and else by LATIN_WORD. Other texts, and those that may hold a special token, go to the library whole.
    """
    global _young, _old
    if len(_young) > REMEMBERED:
        _young, _old = {}, _young
    out: list[bytes] = [b""] * len(texts)
    group: list[int] = []
    lower: list[bytes] = []
    held = 0

    def flush() -> None:
        for k, ids in zip(group, _encode_plain(lower, path), strict=True):
            out[k] = ids
        group.clear()
        lower.clear()

    for i, t in enumerate(texts):
        plain = _plain_text(t)
        if plain is None:
            out[i] = _encode_other(t, path)
            continue
        group.append(i)
        lower.append(plain)
        held += len(plain)
        if held >= PIECE:
            flush()
            held = 0
    flush()
    end = END_ID.to_bytes(WIDTH, "little")
    return [ids + end for ids in out]


def _encode_other(text: bytes, path: str) -> bytes:
    if b"<|" not in text:
        try:
            decoded = text.decode("utf-8")
            decoded.encode("latin-1")
        except UnicodeError:
            pass
        else:
            words = LATIN_WORD.findall(decoded.lower())
            distinct = list(dict.fromkeys(words))
            known = dict(zip(distinct, _library(distinct, path), strict=True))
            return b"".join(map(known.__getitem__, words))
    return _pack(_tokenizer(path).encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids)


def cut(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream, chosen by its content."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    gear = _GEAR[ids & 0xFFFF]
    rolled = gear.copy()
    for j in range(1, WINDOW):
        rolled[j:] += gear[:-j] * _ODD[j]
    ends, last = [], 0
    for e in (np.flatnonzero((rolled >> np.uint32(7)) & np.uint32(MASK) == 0) + 1).tolist():
        while e - last > MOST:
            last += MOST
            ends.append(last)
        if e - last >= LEAST and e < n:
            ends.append(e)
            last = e
    while n - last > MOST:
        last += MOST
        ends.append(last)
    return [*ends, n]


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


class Merkle:
    """Root of a binary Merkle tree over leaves that come one by one; it holds one hash per level."""

    def __init__(self) -> None:
        self.levels: list[bytes | None] = []

    def add(self, leaf: bytes) -> None:
        node = hashlib.sha256(b"\x00" + leaf).digest()
        for k, other in enumerate(self.levels):
            if other is None:
                self.levels[k] = node
                return
            node, self.levels[k] = hashlib.sha256(b"\x01" + other + node).digest(), None
        self.levels.append(node)

    def root(self) -> bytes:
        node = b""
        for other in self.levels:
            if other is not None:
                node = hashlib.sha256(b"\x01" + other + node).digest() if node else other
        return node


_ENCODED = pa.schema([("key", pa.binary()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("recipe", pa.binary()), ("data", pa.binary())])
_ENTRY = struct.Struct("<16sI")


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """A recipe row for each document and a row for each chunk that the task has not sent yet."""
    sent: set[bytes] = set()
    for batch in batches:
        rows: list[tuple] = []
        for doc, ids in zip(batch.column(0).to_pylist(), encode_texts(raw(batch.column(1)), path), strict=True):
            begin, recipe = 0, []
            for end in cut(np.frombuffer(ids, f"<u{WIDTH}")):
                data = ids[begin * WIDTH : end * WIDTH]
                d = digest(data)
                recipe.append(_ENTRY.pack(d, end - begin))
                if d not in sent:
                    sent.add(d)
                    rows.append((d, None, None, None, data))
                begin = end
            recipe = b"".join(recipe)
            rows.append((hashlib.blake2b(recipe + str(doc).encode(), digest_size=8).digest(), doc, len(ids) // WIDTH, recipe, None))
        if len(sent) > SENT:
            sent.clear()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ENCODED.types, strict=True)], schema=_ENCODED)


def _unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of equal chunks in a partition, the first; recipes pass."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for key, recipe in zip(batch.column(0).to_pylist(), batch.column(3).is_valid().to_pylist(), strict=True):
            keep.append(recipe or key not in seen)
            if not recipe:
                seen.add(key)
        yield batch.filter(pa.array(keep, pa.bool_()))


_RECIPES = pa.schema([("part", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("start", pa.int64()), ("recipe", pa.binary())])


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of a sorted part and add up its tokens; the last row, without a recipe, has the part's root."""
    part, row, start, tree = TaskContext.get().partitionId(), 0, 0, Merkle()
    for batch in batches:
        counts = np.array(batch.column(1).to_pylist(), np.int64)
        starts = start + np.cumsum(counts) - counts
        n = len(counts)
        for k, (doc, tokens, recipe) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            tree.add(_leaf(row + k, doc, tokens, recipe))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(row + np.arange(n)), batch.column(0), batch.column(1), pa.array(starts), batch.column(2)], schema=_RECIPES)
        row, start = row + n, start + int(counts.sum())
    if row:
        yield pa.RecordBatch.from_pylist([{"part": part, "row": -1, "doc_id": row, "n_tokens": start, "start": 0, "recipe": b"root:" + tree.root()}], schema=_RECIPES)


def _leaf(row: int, doc: int | None, tokens: int, recipe: bytes) -> bytes:
    return hashlib.sha256(f"{row}:{doc}:{tokens}:".encode() + recipe).digest()


def write_store(docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, null as empty, and write chunks, recipes and manifest below ``folder``.

    Files are in ascending id order, null ids last; rows that repeat an id are all kept. An empty table gives empty
    folders. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    encoded = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(partial(_encode, path=tokenizer_path), "key binary, doc_id long, n_tokens long, recipe binary, data binary")
    once = encoded.repartition("key").mapInArrow(_unique, encoded.schema).withColumn("kind", F.when(F.col("recipe").isNull(), "chunk").otherwise("recipe"))
    once.write.partitionBy("kind").option("compression", "zstd").parquet(f"{folder}/encoded")
    recipes = _encoded(spark, folder).where("kind = 'recipe'").select("doc_id", "n_tokens", "recipe", "key")
    order = [F.col("doc_id").asc_nulls_last(), F.col("key")]
    parts = recipes.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "n_tokens", "recipe")
    parts.mapInArrow(_number, "part int, row long, doc_id long, n_tokens long, start long, recipe binary").write.partitionBy("part").parquet(f"{folder}/recipes")
    parts_written = manifest(spark, folder)
    # one row: the root over all files, which reading back holds against the files' manifests
    spark.createDataFrame([(bytearray(corpus_root(parts_written)),)], "root binary").coalesce(1).write.parquet(f"{folder}/root")


def _encoded(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("key binary, doc_id long, n_tokens long, recipe binary, data binary, kind string").parquet(f"{folder}/encoded")


def _recipes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("row long, doc_id long, n_tokens long, start long, recipe binary, part int").parquet(f"{folder}/recipes")


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The chunk store (key, data)."""
    return _encoded(spark, folder).where("kind = 'chunk'").select("key", "data")


def manifest(spark: SparkSession, folder: str) -> list[tuple[int, int, int, bytes]]:
    """(part, documents, tokens, Merkle root) of each file in order: as many rows as files."""
    rows = _recipes(spark, folder).where("row = -1").select("part", "doc_id", "n_tokens", F.expr("substring(recipe, 6)").alias("root")).collect()
    return sorted((r[0], r[1], r[2], bytes(r[3])) for r in rows)


def corpus_root(parts: list[tuple[int, int, int, bytes]]) -> bytes:
    tree = Merkle()
    for part, docs, tokens, root in parts:
        tree.add(f"{part}:{docs}:{tokens}:".encode() + root)
    return tree.root()


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each recipe row's leaf, made again from what the file says."""
    for batch in batches:
        leaves = [_leaf(*row) for row in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(leaves, pa.binary())], names=["part", "row", "n_tokens", "leaf"])


_ROOTS = pa.schema([("part", pa.int32()), ("documents", pa.int64()), ("tokens", pa.int64()), ("root", pa.binary())])


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, tokens and Merkle root of each part, from leaves sorted by part and row."""
    now, tree, count, total = None, Merkle(), 0, 0
    for batch in batches:
        for part, tokens, leaf in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part != now:
                if now is not None:
                    yield pa.RecordBatch.from_pylist([{"part": now, "documents": count, "tokens": total, "root": tree.root()}], schema=_ROOTS)
                now, tree, count, total = part, Merkle(), 0, 0
            tree.add(leaf)
            count, total = count + 1, total + tokens
    if now is not None:
        yield pa.RecordBatch.from_pylist([{"part": now, "documents": count, "tokens": total, "root": tree.root()}], schema=_ROOTS)


def verify_roots(spark: SparkSession, folder: str) -> list[int]:
    """The parts whose rows, in order, do not give the manifest's documents, tokens and root; -1 for the root over all.

    Only leaves are shuffled, 32 bytes and two numbers a document.
    """
    said = manifest(spark, folder)
    leaves = _recipes(spark, folder).where("row >= 0").select("part", "row", "doc_id", "n_tokens", "recipe").mapInArrow(_leaves, "part int, row long, n_tokens long, leaf binary")
    ordered = leaves.repartition("part").sortWithinPartitions("part", "row").select("part", "n_tokens", "leaf")
    # as many rows as files
    found = {r[0]: (r[1], r[2], bytes(r[3])) for r in ordered.mapInArrow(_roots, "part int, documents long, tokens long, root binary").collect()}
    wrong = [part for part, *rest in said if found.pop(part, None) != tuple(rest)] + sorted(found)
    kept = [bytes(r[0]) for r in spark.read.schema("root binary").parquet(f"{folder}/root").collect()]
    return wrong if kept == [corpus_root(said)] else [-1, *wrong]


# --- crc32 of joined chunks ----------------------------------------------------------------------------------------


def _shift_tables() -> np.ndarray:
    """tables[k][b][v]: what byte b of a crc32, of value v, becomes after 2**k zero bytes."""
    step = np.zeros(32, np.uint64)  # the operator for one zero bit, as images of the unit vectors
    step[0] = 0xEDB88320
    step[1:] = 1 << np.arange(31, dtype=np.uint64)

    def times(op: np.ndarray, vec: np.ndarray) -> np.ndarray:
        out = np.zeros_like(vec)
        for i in range(32):
            out ^= np.where((vec >> np.uint64(i)) & np.uint64(1), op[i], np.uint64(0))
        return out

    for _ in range(3):
        step = times(step, step)
    values = np.arange(256, dtype=np.uint64)
    tables = np.zeros((48, 4, 256), np.uint32)
    for k in range(48):
        for b in range(4):
            tables[k, b] = times(step, values << np.uint64(8 * b))
        step = times(step, step)
    return tables


_shift: list[np.ndarray] = []


def shift_crc(crcs: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """The crc32s as they count before so many more bytes: crc(a + b) = shift(crc(a), len(b)) ^ crc(b)."""
    if not _shift:
        _shift.append(_shift_tables())
    crcs, zeros = crcs.astype(np.uint32), zeros.astype(np.int64)
    for k in range(48):
        if not (zeros >> k).any():
            break
        on = (zeros >> k) & 1 == 1
        x, t = crcs[on], _shift[0][k]
        crcs[on] = t[0][x & 255] ^ t[1][(x >> 8) & 255] ^ t[2][(x >> 16) & 255] ^ t[3][x >> 24]
    return crcs


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Check a chunk against its digest; its number of ids, and the crc32 of these as 4 bytes each."""
    for batch in batches:
        keys, n, crc = batch.column(0).to_pylist(), [], []
        for key, data in zip(keys, batch.column(1).to_pylist(), strict=True):
            if digest(data) != key:
                raise ValueError(f"chunk {key.hex()} has other bytes than its digest says")
            n.append(len(data) // WIDTH)
            crc.append(zlib.crc32(np.frombuffer(data, f"<u{WIDTH}").astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["key", "n", "crc"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each chunk of a recipe: the recipe's digest, the chunk's digest and length, the bytes after it."""
    for batch in batches:
        whole, keys, ns, after = [], [], [], []
        for recipe in batch.column(0).to_pylist():
            entries = list(_ENTRY.iter_unpack(recipe))
            rest, d = 4 * sum(n for _, n in entries), digest(recipe)
            for key, n in entries:
                rest -= 4 * n
                whole.append(d)
                keys.append(key)
                ns.append(n)
                after.append(rest)
        yield pa.RecordBatch.from_arrays([pa.array(whole, pa.binary()), pa.array(keys, pa.binary()), pa.array(ns, pa.int64()), pa.array(after, pa.int64())], names=["whole", "key", "said", "after"])


def _shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        whole, said, n, crc, after = batch.columns
        if n.null_count or said.to_numpy().tolist() != n.to_numpy().tolist():
            raise ValueError("a recipe names a chunk that the store lacks or that has another length")
        yield pa.RecordBatch.from_arrays([whole, n, pa.array(shift_crc(crc.to_numpy(), after.to_numpy()).astype(np.int64))], names=["whole", "n", "crc"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([digest(r) for r in batch.column(4).to_pylist()], pa.binary())], names=["part", "doc_id", "n_tokens", "start", "whole"])


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32.

    Raises ValueError where a part's recipes, order or counts differ from its Merkle root, a part is missing, or the
    parts differ from the root over all. Each chunk is read once and checked against its digest.
    """
    small_batches(spark)
    if wrong := verify_roots(spark, folder):
        raise ValueError(f"the store's Merkle roots differ from its files: parts {wrong} (-1: the root over all)")
    recipes = _recipes(spark, folder).where("row >= 0")
    facts = chunks(spark, folder).mapInArrow(_facts, "key binary, n long, crc long")
    distinct = recipes.select("recipe").distinct()
    entries = distinct.mapInArrow(_entries, "whole binary, key binary, said long, after long").join(facts, "key", "left")
    wholes = entries.select("whole", "said", "n", "crc", "after").mapInArrow(_shifted, "whole binary, n long, crc long").groupBy("whole").agg(F.sum("n").alias("n_read"), F.expr("bit_xor(crc)").alias("ids_crc32"))
    wholes = stored(wholes, "read-back")  # as a table of its own, so that the join below can split a hot recipe
    before, bases = 0, []
    for part, _, tokens, _ in manifest(spark, folder):
        bases.append((part, before))
        before += tokens
    # one row per file
    based = F.broadcast(spark.createDataFrame(bases, "part int, base long"))
    keyed = recipes.select("part", "doc_id", "n_tokens", "start", "recipe").mapInArrow(_keyed, "part int, doc_id long, n_tokens long, start long, whole binary")
    checked = F.when(F.col("n_read") == F.col("n_tokens"), F.col("n_read")).otherwise(F.raise_error(F.lit("a document's chunks do not add up to its tokens")).cast("long"))
    return keyed.join(wholes, "whole").join(based, "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), checked.alias("n_tokens"), "ids_crc32")


def token_store(docs: DataFrame, tokenizer_path: str, folder: str | None = None) -> DataFrame:
    """Write the store below ``folder`` and read it back: one row per document, doc_id, start, n_tokens, ids_crc32.

    Null and empty texts have the end id alone. Null ids come last; rows that repeat an id or a text are all kept. An
    empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "store")
    write_store(docs, folder, tokenizer_path)
    return read_store(spark, folder)
