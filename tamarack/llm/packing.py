"""Best-fit-decreasing packing of tokenized documents into fixed windows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm import tokens
from tamarack.llm.common import Scratch, map_arrow, strings

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class RoomTree:
    """Open windows by remaining room: a segment tree whose leaves count the windows of each room.

    ``take(n)`` removes a window of the least room that is at least ``n``.
    """

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, which: int) -> None:
        self.open[room].append(which)
        k = self.size + room
        while k:
            self.count[k] += 1
            k >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        count, k = self.count, self.size + least
        while not count[k]:  # up to the first subtree on the right that has a window
            while k & 1:
                k >>= 1
            if not k:
                return None
            k += 1
        while k < self.size:
            k <<= 1
            if not count[k]:
                k += 1
        room = k - self.size
        while k:
            count[k] -= 1
            k >>= 1
        return room, self.open[room].pop()


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int], int]:
    """Window number and offset of each piece of at most ``window``, and how many windows there are."""
    place, offset, windows = [0] * len(lengths), [0] * len(lengths), 0
    tree = RoomTree(window)
    for k in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[k]
        found = tree.take(n)
        room, which = found or (window, windows)
        if found is None:
            windows += 1
        place[k], offset[k] = which, window - room
        if room > n:
            tree.add(room - n, which)
    return place, offset, windows


#: Pieces that one task packs together.
PACKED_TOGETHER = 100_000


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, end_id: int = 0, tokenizer: str | None = None, together: int = PACKED_TOGETHER) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and then ``end_id``. One longer than ``window`` is first cut into full
    windows, which are sequences of their own. What is left of each document, one row of numbers,
    is dealt by hash to as many tasks as its counted number needs at ``together`` a task (about),
    and packed there best fit decreasing, so padding does not depend on how the documents are
    divided: of 1,000 documents or more it is some thousandths. Memory does not grow with the input.

    Null and empty texts are the single ``end_id``. Repeated rows are packed once each, ties are
    packed in the order of their pieces, null ids stay null, a very long text is encoded as a
    whole, an empty table gives no row, other columns are not read.
    """
    path = tokenizer or tokens.default_path()
    crc = zlib.crc32
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, piece, end = tokens.encoder(path), TaskContext.get().partitionId() << 34, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                data = ids.encode(text) + end
                total, step = len(data) // 4, window * 4
                for at in range(0, len(data), step):
                    part = data[at : at + step]
                    rows.append((doc, at // 4, len(part) // 4, crc(part), total, 2 * piece, 0))
                    piece += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).sort_by("sequence_id").combine_chunks()
            lengths, own = table["length"].to_pylist(), table["sequence_id"].to_pylist()
            place, offset, windows = best_fit(lengths, window)
            first = [0] * windows  # a sequence has the odd number after its first piece's
            for k, (p, o) in enumerate(zip(place, offset, strict=True)):
                if o == 0:
                    first[p] = own[k] + 1
            columns = [*[table[c].combine_chunks() for c in names[:5]], pa.array([first[p] for p in place], pa.int64()), pa.array(offset, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 2 * together:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    pieces = map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), cut, SCHEMA)
    pieces = Scratch(docs.sparkSession, "packing").cut(pieces, "pieces")
    left = pieces.where(F.col("length") < window)
    tasks = -(-left.count() // together)
    packed = map_arrow(left.repartition(max(1, tasks), F.xxhash64("sequence_id")), fit, SCHEMA)
    return pieces.where(F.col("length") == window).union(packed)
