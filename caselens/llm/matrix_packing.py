"""Best-fit-decreasing packing into token-id matrices (operator 3).

Every Spark task turns the documents it scans into token ids, gathers pieces up
to a fixed number of tokens, and packs each such block best-fit-decreasing: the
pieces by falling length, each into the bin with the least free space that
holds it, found in a segment tree over free space. A block becomes rows of a
packed id matrix, each with its segments' cumulative lengths and the positions
where counting restarts. Documents over the capacity are split at multiples of
it, and (row_id, start) of each segment restores them without loss: row_id is a
number of the row in its run, so rows that share a doc_id stay apart. Blocks are
bounded by tokens, so memory is bounded, and no row is shuffled.

Defined results: a null or empty text is the separator alone; repeated rows and
rows with a null doc_id are packed once each; a text of any length is encoded
whole and may span many sequences; pieces of one length are placed in the order
read; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage, tokens

CAPACITY = 2048
BLOCK_TOKENS = 4_000_000

PACKED = "sequence_id long, n_tokens int, n_segments int, id_bytes int, doc_ids array<long>, row_ids array<long>, starts array<long>, cu_seqlens array<int>, position_resets array<int>, input_ids binary"


class FreeSpaceTree:
    """Counts of bins by free space; the least free space of at least n is found in log time."""

    def __init__(self, capacity: int):
        self.size = 1 << int(capacity).bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, free: int, by: int) -> None:
        at = free + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def push(self, free: int, at: int) -> None:
        self.bins[free].append(at)
        self._add(free, 1)

    def pop_at_least(self, need: int) -> tuple[int, int] | None:
        """The (free space, bin) of least free space >= need, taken out; None if there is none."""
        node, count, size = need + self.size, self.count, self.size
        if not count[node]:
            while True:
                while node & 1:
                    node >>= 1
                if not node:
                    return None
                node += 1
                if count[node]:
                    break
                if node == 1:
                    return None
            while node < size:
                node *= 2
                node += not count[node]
        free = node - size
        self._add(free, -1)
        return free, self.bins[free].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """The indices in each bin, in order of placing."""
    tree, out = FreeSpaceTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.pop_at_least(lengths[i])
        if found is None:
            free, at = capacity, len(out)
            out.append([])
        else:
            free, at = found
        out[at].append(i)
        if free > lengths[i]:
            tree.push(free - lengths[i], at)
    return out


def packed_matrix(docs: DataFrame, *, vocabulary: str | None = None, capacity: int = CAPACITY, separator: int = 0, pad: int | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """A row per sequence. ``input_ids``: little-endian unsigned 16-bit ids where the
    vocabulary allows it, else 32-bit, padded to the capacity if ``pad`` is given;
    ``cu_seqlens`` starts at 0; ``position_resets``: where position ids restart."""
    path = vocabulary or tokens.default_vocabulary()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = tokens.encoder(path)
        wide = "<u2" if enc.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        next_id = next_row = TaskContext.get().partitionId() << 40
        width = int(wide[-1])

        def flush(pieces: list[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal next_id
            bins = best_fit_decreasing([len(p[3]) for p in pieces], capacity)
            for a in range(0, len(bins), 1024):
                cols: list[list] = [[] for _ in range(10)]
                for members in bins[a : a + 1024]:
                    parts = [pieces[i] for i in members]
                    cu = [0, *np.cumsum([len(p[3]) for p in parts]).tolist()]
                    ids = np.concatenate([p[3] for p in parts])
                    if pad is not None:
                        ids = np.concatenate([ids, np.full(capacity - len(ids), pad, wide)])
                    for out, v in zip(cols, (next_id, cu[-1], len(parts), width, *([p[i] for p in parts] for i in range(3)), cu, cu[:-1], ids.astype(wide).tobytes()), strict=True):
                        out.append(v)
                    next_id += 1
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in PACKED.split(", ")])

        held, n = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(np.frombuffer(enc.encode(text or ""), "<u4"), separator).astype(wide)
                for start in range(0, len(ids), capacity):
                    held.append((doc, next_row, start, ids[start : start + capacity]))
                next_row += 1
                n += len(ids)
                if n >= block_tokens:
                    yield from flush(held)
                    held, n = [], 0
        if held:
            yield from flush(held)

    storage.small_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(pack, PACKED)


def write_matrix(packed: DataFrame, path: str) -> None:
    """The packed rows as Parquet, by Spark's own committer, to a folder all executors reach."""
    packed.write.mode("errorifexists").parquet(path)


def unpack(packed: DataFrame) -> DataFrame:
    """doc_id, row_id, start and ids (hex) of every segment: the inverse of packing."""
    at = F.posexplode("doc_ids").alias("k", "doc_id")
    rows = packed.select("starts", "row_ids", "cu_seqlens", "input_ids", "id_bytes", at)
    begin, stop = F.get("cu_seqlens", F.col("k")), F.get("cu_seqlens", F.col("k") + 1)
    ids = F.substring("input_ids", begin * F.col("id_bytes") + 1, (stop - begin) * F.col("id_bytes"))
    return rows.select("doc_id", F.get("row_ids", F.col("k")).alias("row_id"), F.get("starts", F.col("k")).alias("start"), F.hex(ids).alias("ids_hex"))
