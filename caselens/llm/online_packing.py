"""Bounded-space online best-fit packing (operator 10).

Documents become token ids by a public vocabulary, each ended by a separator.
Documents longer than the capacity are cut into full pieces and a shorter last
one; nothing else is cut. Pieces then stream through a fixed number of open
bins, kept in a bitset keyed by free space: a piece goes into the bin with the
least free space that holds it, and where none does and all bins are open, the
fullest closes first. Of equally full bins the one opened first is taken, both
to fill and to close.

Every Spark task packs the pieces it reads, in the order of the pieces table,
with memory for its open bins alone; no rows are shuffled or gathered, so
neither a hot source nor many copies of a document matter.

Defined results: a null or empty text is the separator alone; repeated rows
(and rows with a null doc_id) are packed once per row; a text of any length is
encoded whole and cut only into pieces; an empty table gives no rows; other
columns are ignored whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from . import storage, tokens

CAPACITY = 2048
OPEN_BINS = 2048


class OpenBins:
    """A fixed number of open bins, found by free space through a bitset."""

    def __init__(self, capacity: int, most: int, first_id: int = 0):
        self.capacity, self.most, self.next_id = capacity, most, first_id
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0
        self.n_open = 0

    def _take(self, free: int) -> int:
        at = heappop(self.bins[free])
        if not self.bins[free]:
            self.mask ^= 1 << free
        self.n_open -= 1
        return at

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it for a piece of ``length`` tokens."""
        fits = self.mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            at = self._take(free)
        else:
            if self.n_open >= self.most:
                self._take((self.mask & -self.mask).bit_length() - 1)
            at, free = self.next_id, self.capacity
            self.next_id += 1
        left = free - length
        if left:
            if not self.bins[left]:
                self.mask |= 1 << left
            heappush(self.bins[left], at)
            self.n_open += 1
        return at, self.capacity - free


def token_pieces(docs: DataFrame, *, vocabulary: str | None = None, capacity: int = CAPACITY, separator: int = 0) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32."""
    path = vocabulary or tokens.default_vocabulary()
    end = np.array([separator], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = enc.encode(text or "") + end
                n = len(ids) // 4
                for k, start in enumerate(range(0, n, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    for out, v in zip(rows, (doc, k, start, len(part) // 4, zlib.crc32(part)), strict=True):
                        out.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    storage.small_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_pieces(pieces: DataFrame, *, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` of 1 to ``capacity``."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        bins = OpenBins(capacity, open_bins, TaskContext.get().partitionId() << 40)
        for frame in frames:
            at = [bins.place(n) for n in frame["length"].tolist()]
            yield frame.assign(sequence_id=np.array([x for x, _ in at], "int64"), offset=np.array([x for _, x in at], "int64"))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return pieces.mapInPandas(pack, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, *, vocabulary: str | None = None, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    pieces = storage.materialize(token_pieces(docs, vocabulary=vocabulary, capacity=capacity), "pieces")
    return pack_pieces(pieces, capacity=capacity, open_bins=open_bins)
