"""Greedy packing. A batch starts anew where a limit is passed, so no running total over the whole group can tell it.

Both folds run over a hash-partitioned, sorted stream of Arrow batches; what they carry from one batch to the next is the
group, the batch's number and how full it is, so no group is held in memory. Null groups are one group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_bytes(text: str, limit: int) -> list[str]:
    """Pieces of at most ``limit`` UTF-8 bytes that split no character."""
    if len(text.encode()) <= limit:
        return [text]
    data, pieces, start = text.encode(), [], 0
    while start < len(data):
        end = min(len(data), start + limit)
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        pieces.append(data[start:end].decode())
        start = end
    return pieces


class _Fill:
    """How a group's open batch is filled; batches are found by search in the prefix sums of sizes."""

    def __init__(self, most: int | None, limit: int, gap: int = 0) -> None:
        self.most, self.limit, self.gap = most, limit, gap
        self.begin()

    def begin(self) -> None:
        self.batch, self.count, self.size = 0, 0, 0

    def place(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(batch, place in it) of the group's next pieces, of these sizes."""
        ends = np.concatenate([[0], np.cumsum(sizes + self.gap)])
        batch, place = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
        at = 0
        while at < len(sizes):
            fits = int(np.searchsorted(ends, ends[at] + self.limit + self.gap - self.size, side="right")) - 1
            stop = min(fits, len(sizes), at + self.most - self.count if self.most else len(sizes))
            stop = max(stop, at + (self.count == 0))  # an empty batch takes one piece whatever its size
            batch[at:stop], place[at:stop] = self.batch, self.count + np.arange(stop - at)
            self.count, self.size = self.count + stop - at, self.size + int(ends[stop] - ends[at])
            if stop < len(sizes):
                self.batch, self.count, self.size = self.batch + 1, 0, 0
            at = stop
        return batch, place


def _runs(groups: list) -> Iterator[tuple[int, int]]:
    """Where runs of one group begin and end."""
    start = 0
    for i in range(1, len(groups) + 1):
        if i == len(groups) or groups[i] != groups[start]:
            yield start, i
            start = i


def _sorted(messages: DataFrame, group: str, order: str, text: Column) -> DataFrame:
    return messages.select(F.col(group).alias("g"), F.col(order).alias("o"), text.alias("t")).repartition("g").sortWithinPartitions("g", "o")


def pack_messages(messages: DataFrame, group: str, order: str, text: str, max_messages: int, max_bytes: int) -> DataFrame:
    """(group, batch, place, order, piece, bytes): messages in batches of at most so many pieces and bytes.

    A message over the byte limit is split between characters first. A null or empty message is an error.
    """
    if max_messages <= 0:
        raise ValueError("a batch needs room for a message")
    if max_bytes < len("\U0010ffff".encode()):
        raise ValueError("a batch needs room for any character")
    kinds = dict(messages.dtypes)
    schema = f"g {kinds[group]}, batch long, place long, o {kinds[order]}, piece string, bytes long"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fill, current = _Fill(max_messages, max_bytes), object()
        for rows in batches:
            groups = rows.column(0).to_pylist()
            pieces = [split_bytes(t, max_bytes) for t in rows.column(2).to_pylist()]
            number, place, width = [], [], []
            for a, b in _runs(groups):
                if groups[a] != current:
                    current = groups[a]
                    fill.begin()
                sizes = np.array([len(p.encode()) for x in pieces[a:b] for p in x], np.int64)
                found = fill.place(sizes)
                number.append(found[0])
                place.append(found[1])
                width.append(sizes)
            source = pa.array(np.repeat(np.arange(len(groups)), [len(x) for x in pieces]))
            none = np.zeros(0, np.int64)
            columns = [pa.array(np.concatenate([none, *x])) for x in (number, place, width)]
            flat = pa.array([p for x in pieces for p in x], pa.string())
            yield pa.RecordBatch.from_arrays([rows.column(0).take(source), columns[0], columns[1], rows.column(1).take(source), flat, columns[2]], names=["g", "batch", "place", "o", "piece", "bytes"])

    checked = F.when(F.length(text) > 0, F.col(text)).otherwise(F.raise_error(F.lit("a message is empty")))
    return _sorted(messages, group, order, checked).mapInArrow(fold, schema).withColumnsRenamed({"g": group, "o": order})


def chunk_documents(messages: DataFrame, group: str, order: str, text: str, max_chars: int, separator: str = "\n\n") -> DataFrame:
    """(group, chunk, order, chars): messages joined by a separator into chunks of at most so many characters.

    A chunk has one message at least, however long; null counts as empty.
    """
    kinds = dict(messages.dtypes)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fill, current = _Fill(None, max_chars, len(separator)), object()
        for rows in batches:
            groups, sizes, number = rows.column(0).to_pylist(), rows.column(2).to_numpy().astype(np.int64), []
            for a, b in _runs(groups):
                if groups[a] != current:
                    current = groups[a]
                    fill.begin()
                number.append(fill.place(sizes[a:b])[0])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.concatenate([np.zeros(0, np.int64), *number])), rows.column(1), pa.array(sizes)], names=["g", "chunk", "o", "chars"])

    chars = F.coalesce(F.length(text), F.lit(0)).cast("long")
    return _sorted(messages, group, order, chars).mapInArrow(fold, f"g {kinds[group]}, chunk long, o {kinds[order]}, chars long").withColumnsRenamed({"g": group, "o": order})


def chunk_texts(messages: DataFrame, group: str, order: str, text: str, max_chars: int, header: Column, separator: str = "\n\n") -> DataFrame:
    """(group, chunk, document): the chunks of ``chunk_documents`` as texts under a header, which may use group and chunk.

    The limit holds for the messages, so a chunk's text has some max_chars or one message.
    """
    placed = chunk_documents(messages, group, order, text, max_chars, separator).select(F.col(group).alias("_g"), F.col(order).alias("_o"), "chunk")
    rows = messages.join(placed, F.col(group).eqNullSafe(F.col("_g")) & (F.col(order) == F.col("_o")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(text, F.lit("")).alias("t")))), lambda p: p["t"])
    whole = rows.groupBy(group, "chunk").agg(F.array_join(parts, separator).alias("_text"))
    return whole.select(group, "chunk", F.concat(header, F.lit(separator), "_text").alias("document"))
