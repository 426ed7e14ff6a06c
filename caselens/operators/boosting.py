"""Histogram trees as Spark jobs: boosted quantiles, boosted probabilities and quantile forests.

Features are cut into at most BINS bins, a missing value being bin 0, and the
binned rows are stored once; what a fit reads of them is stored again in blocks
of BLOCK rows, whose columns are numpy's own bytes. A level of trees is one pass
over the blocks: each task sums gradients and weights by (model, node, feature,
bin) in numpy, two features at a time, Spark adds the tasks' sums up, and the
splits are picked on that table, whose size depends on parameters alone. Models are columns of one pass: nine quantile levels, all
models of a nested cross-validation (each leaves out its folds), or the trees of
a forest grow together, so the number of passes is that of one model. Tasks work
out a row's prediction so far from the trees themselves; nothing about rows is
kept between passes, and no row reaches the driver. Where models leave out
different folds a block's rows are of one fold, so a model passes over whole
blocks, and trees of depth 3 are read from tables, eight at a time (Walk).

At every split the rows without the feature go to the side that gains more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import store

BINS = 32
#: Rows of a block.
BLOCK = 1 << 14
SHRINK = 1.0
#: Cells of the value grid from which weighted quantiles are read.
GRID = 2048
#: Trees up to this depth have their leaves in a byte, a bit each; a word holds as many of them as it has bytes.
BYTE_DEPTH, WORD_TREES = 3, 8
#: Distribution function of a Poisson variable of mean 1.
POISSON = np.cumsum([0.36787944117144233, 0.36787944117144233, 0.18393972058572117, 0.06131324019524039, 0.015328310048810098, 0.003065662009762019, 0.0005109436682936699])


@dataclass
class Forest:
    """Complete binary trees of a depth; arrays are [round, model, node], leaves' values [round, model, leaf]."""

    depth: int
    models: int
    start: np.ndarray
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    missing_right: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def grow(self) -> None:
        """A further round of trees without splits."""
        inner = (self.models, 2**self.depth - 1)
        self.feature.append(np.full(inner, -1))
        self.cut.append(np.zeros(inner, np.int64))
        self.missing_right.append(np.zeros(inner, bool))
        self.value.append(np.zeros((self.models, 2**self.depth)))

    def nodes(self, x: np.ndarray, r: int, m: int, levels: int) -> np.ndarray:
        """The node each row reaches in model m's tree of round r after so many levels, counted from 0 within the level.
        ``x`` has a row of bins for each feature, so a split compares one row with a number."""
        at = np.zeros(x.shape[1], np.uint8 if levels <= 8 else np.uint16)
        for level in range(levels):
            right = np.zeros(x.shape[1], bool)
            for node in range(2**level):
                i = 2**level - 1 + node
                if (f := self.feature[r][m, i]) >= 0:
                    goes = x[f] > self.cut[r][m, i]
                    if self.missing_right[r][m, i]:
                        goes |= x[f] == 0
                    right |= goes & (at == node) if level else goes
            at += at
            at += right
        return at

    def raw_of(self, x: np.ndarray, m: int, rounds: int | None = None) -> np.ndarray:
        """Model m's sum of start and leaf values."""
        out = np.full(x.shape[1], self.start[m])
        for r in range(len(self.feature) if rounds is None else rounds):
            # Nodes are in range: clipping only spares the check.
            out += self.value[r][m].take(self.nodes(x, r, m, self.depth), mode="clip")
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        """A column a model."""
        return np.stack([self.raw_of(x, m) for m in range(self.models)], 1)


def grouped(widths: Sequence[int], nodes: int = 1) -> list[tuple[int, ...]]:
    """Features, by their numbers of bins, in as few groups as keep the numbers of a group's bins together few."""
    for k in range(1, len(widths) + 1):
        groups, sizes = [[] for _ in range(k)], [1] * k
        for f in sorted(range(len(widths)), key=lambda f: -widths[f]):
            least = sizes.index(min(sizes))
            groups[least].append(f)
            sizes[least] *= widths[f]
        if max(sizes) * max(nodes, 4) <= BLOCK:
            break
    return [tuple(sorted(g)) for g in groups if g]


@dataclass(frozen=True)
class Rows:
    """Bins of some rows, a row a feature."""

    x: np.ndarray
    known: dict = field(default_factory=dict, kw_only=True)

    def code(self, group: tuple[int, ...], widths: Sequence[int]) -> np.ndarray:
        """One number for the rows' bins of a group of features; it is made once."""
        if group not in self.known:
            code = self.x[group[0]].astype(np.intp)
            for f in group[1:]:
                code = code * widths[f] + self.x[f]
            self.known[group] = code
        return self.known[group]


@dataclass(frozen=True)
class Batch(Rows):
    """A block's rows in a task, with target, weight, how often each model draws a row (a row a model, or None: once),
    the models that see the block, and the rows' fold where models differ in what they see."""

    y: np.ndarray
    w: np.ndarray
    times: np.ndarray | None
    models: Sequence[int]
    fold: int | None

    def weight(self, m: int) -> np.ndarray:
        """Rows' weights for model m, which sees the block."""
        return self.w if self.times is None else self.w * self.times[m]


class Walk:
    """Where rows stand before round ``r``, and the node they reach in that round's tree after so many levels.

    A split leaves open one side's leaves, so each bin of a feature leaves open some leaves of each tree, and the leaf that all
    features leave open is a row's. With a bit a leaf and a byte a tree, one table a group of features, looked up by the rows'
    numbers, does this for eight trees at once. Tables depend on parameters alone and are made where they are used.
    Deeper trees are walked split by split.
    """

    def __init__(self, forest: Forest, r: int, level: int, widths: Sequence[int]) -> None:
        self.forest, self.r, self.level, self.widths = forest, r, level, widths
        self.groups, self.trees, self.made = grouped(widths), r + (level > 0), {}

    def _tables(self, m: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        if m in self.made:
            return self.made[m]
        forest, bins = self.forest, np.arange(max(self.widths))
        every = sum((1 << 2**forest.depth) - 1 << 8 * t for t in range(WORD_TREES))
        open_ = np.full((len(self.widths), -(-self.trees // WORD_TREES), len(bins)), np.uint64(every))
        for t in range(self.trees):
            word, shift = t // WORD_TREES, 8 * (t % WORD_TREES)
            for i in range(2**forest.depth - 1):
                level = (i + 1).bit_length() - 1
                half = 2 ** (forest.depth - level - 1)
                left = ((1 << half) - 1) << (2 * half * (i + 1 - 2**level) + shift)
                if (f := forest.feature[t][m, i]) < 0:
                    open_[0, word] &= ~np.uint64(left << half)
                else:
                    right = (bins > forest.cut[t][m, i]) | ((bins == 0) & forest.missing_right[t][m, i])
                    open_[f, word] &= np.where(right, ~np.uint64(left), ~np.uint64(left << half))
        tables = []
        for g in self.groups:
            table = open_[g[0]][:, : self.widths[g[0]]]
            for f in g[1:]:
                table = (table[:, :, None] & open_[f][:, None, : self.widths[f]]).reshape(len(table), table.shape[1] * self.widths[f])
            tables.append(table)
        leaf, values = 1 << np.arange(2**forest.depth), []
        for t in range(0, self.r - 1, 2):
            values.append(np.zeros(1 << 16))
            values[-1][leaf[:, None] | leaf << 8] = forest.value[t][m][:, None] + forest.value[t + 1][m]
        if self.r % 2:
            values.append(np.zeros(1 << 8))
            values[-1][leaf] = forest.value[self.r - 1][m]
        self.made[m] = tables, values
        return self.made[m]

    def __call__(self, rows: Rows, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Model m's sum of start and leaf values before round r, and nodes counted from 0 within the level."""
        forest, n = self.forest, rows.x.shape[1]
        if forest.depth > BYTE_DEPTH:
            return forest.raw_of(rows.x, m, self.r), forest.nodes(rows.x, self.r, m, self.level) if self.level else np.zeros(n, np.uint8)
        tables, values = self._tables(m)
        leaves = []
        for word in range(len(tables[0])):
            # Numbers are in range: clipping only spares the check.
            left = tables[0][word].take(rows.code(self.groups[0], self.widths), mode="clip")
            for table, g in zip(tables[1:], self.groups[1:], strict=True):
                left &= table[word].take(rows.code(g, self.widths), mode="clip")
            leaves.append(left.astype("<u8", copy=False).view(np.uint8).reshape(n, WORD_TREES))
        raw = np.full(n, forest.start[m])
        for i, value in enumerate(values):
            word, t = divmod(2 * i, WORD_TREES)
            # Two trees' bytes are one number; the last of an odd number of trees is alone.
            raw += value.take(leaves[word].view("<u2")[:, t // 2] if len(value) > 256 else leaves[word][:, t], mode="clip")
        if not self.level:
            return raw, np.zeros(n, np.intp)
        node = np.zeros(256, np.intp)
        node[1 << np.arange(2**forest.depth)] = np.arange(2**forest.depth) >> (forest.depth - self.level)
        return raw, node.take(leaves[self.r // WORD_TREES][:, self.r % WORD_TREES], mode="clip")


def cut_points(rows: DataFrame, features: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """At most ``bins`` - 1 cut points of each feature, near its quantiles, from one aggregate."""
    at = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), at, 10000).alias(f"q{i}") for i, f in enumerate(features)]).first()
    return [np.unique(np.array(q if q is not None else [], float)) for q in found]


def plain(rows: DataFrame, features: Sequence[str], *, target: str, weight: str, key: str | Column, more: Sequence[Column | str] = ()) -> DataFrame:
    """What :func:`binning` reads, without folds, and ``more``."""
    columns = [F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)]
    return rows.select(F.col(target).cast("double").alias("y"), F.col(weight).cast("double").alias("w"), (F.xxhash64(key) if isinstance(key, str) else key).alias("key"), *columns, *more)


def binning(cuts: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A step over batches from features to their bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.zeros((b.num_rows, len(cuts)), np.int32)
            for i, c in enumerate(cuts):
                v = b.column(f"f{i}").to_numpy(zero_copy_only=False)
                x[:, i] = np.where(np.isnan(v), 0, 1 + np.searchsorted(c, v, "left"))
            bins = pa.ListArray.from_arrays(np.arange(0, x.size + 1, len(cuts), dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([bins, *(b.column(k) for k in ("y", "w", "fold", "key"))], ["x", "y", "w", "fold", "key"])

    return run


def binned(rows: DataFrame, features: Sequence[str], cuts: list[np.ndarray], *, target: str, weight: str, fold: str, key: str | Column) -> DataFrame:
    """(x, y, w, fold, key): the bins of every row's features, 0 for a missing one, its target, weight, fold and a 64-bit hash
    of its key. A Column as ``key`` is that hash."""
    read = plain(rows, features, target=target, weight=weight, key=key, more=[F.col(fold).cast("int").alias("fold")])
    return read.mapInArrow(binning(cuts), "x array<int>, y double, w double, fold int, key long")


def bins_of(column: pa.Array) -> np.ndarray:
    """The bins of some rows, a row a feature."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat.astype(bins_type(int(flat.max(initial=0)))).reshape(len(column), -1).T)


def bins_type(highest: int) -> type:
    return np.uint8 if highest < 256 else np.uint16


@contextmanager
def _batches(spark: SparkSession, rows: int | None = None) -> Iterator[None]:
    """Jobs inside pass rows on to Python by their number alone, at most ``rows`` at a time: rows of known size needn't be
    weighed one by one, which takes longer than passing them on."""
    here = {"spark.sql.execution.arrow.maxBytesPerBatch": str(2**31 - 1)} | ({"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)} if rows else {})
    before = {k: spark.conf.get(k, None) for k in here}
    for k, v in here.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_BLOCK_SCHEMA = "n int, x binary, y binary, w binary, fold int, times binary, key binary"
#: Blocks that JVM and task pass on at a time: few, so that both work at once.
BLOCKS_PASSED = 8


def packed(values: np.ndarray) -> bytes:
    """Numbers in the smallest of three types that holds them all exactly; length and number of rows tell which."""
    values = values.astype(float)
    with np.errstate(all="ignore"):
        small = next((v for v in (values.astype(np.uint8), values.astype(np.float32)) if (v == values).all()), values)
    return small.tobytes()


def unpacked(values: pa.Buffer, n: int) -> np.ndarray:
    return np.frombuffer(values, {1: np.uint8, 4: np.float32, 8: float}[values.size // n]).astype(float, copy=False)


def blocks(stored: DataFrame, excluded: Sequence[Sequence[int]], bins: int, drawn: bool, read: Callable | None = None) -> tuple[DataFrame, list[tuple[int, ...]]]:
    """The rows that any model sees, BLOCK of them a row, stored: a fit reads them once a level, so they are laid out for
    its tasks once. With them, the folds among theirs that each model leaves out; where these differ, a block is of one fold.
    ``read`` is a step over batches that makes the rows' (x, y, w, fold, key) of ``stored``, where these aren't its columns."""
    nobody = set.intersection(*[set(e) for e in excluded])
    rest = [tuple(k for k in e if k not in nobody) for e in excluded]
    apart, kind = any(rest), bins_type(bins)
    if not read:
        stored = (stored.where(~F.col("fold").isin(sorted(nobody))) if nobody else stored).select("x", "y", "w", "fold", "key")

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        x = bins_of(t["x"].combine_chunks()).astype(kind)
        y, w, fold, key = (t[k].to_numpy() for k in ("y", "w", "fold", "key"))
        times = times_drawn(key, len(excluded)).T.astype(np.uint8).tobytes() if drawn else None
        values = [pa.array([v], pa.binary()) for v in (x.tobytes(), packed(y), packed(w), times, key.astype(np.int64).tobytes())]
        values.insert(3, pa.array([int(fold[0]) if apart else None], pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array([t.num_rows], pa.int32()), *values], ["n", "x", "y", "w", "fold", "times", "key"])

    def by_fold(b: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
        fold = b.column("fold").to_numpy()
        for k in np.unique(fold) if apart or read else [0]:
            if k not in nobody or not read:
                yield int(k), b.take(pa.array(np.flatnonzero(fold == k))) if apart or read else b

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        for b in read(stream) if read else stream:
            for k, rows in by_fold(b):
                for first in range(0, rows.num_rows, BLOCK):
                    part, before = rows.slice(first, BLOCK), held.setdefault(k, [])
                    if before and sum(h.num_rows for h in before) + part.num_rows > BLOCK:
                        yield block(before)
                        before.clear()
                    before.append(part)
        for before in held.values():
            if before:
                yield block(before)

    with _batches(stored.sparkSession):
        return store(stored.mapInArrow(run, _BLOCK_SCHEMA), "blocks"), rest


def batches_of(stream: Iterator[pa.RecordBatch], excluded: Sequence[Sequence[int]], bins: int) -> Iterator[Batch]:
    kind = bins_type(bins)
    for b in stream:
        for i in range(b.num_rows):
            n, fold = b.column(0)[i].as_py(), b.column(4)[i].as_py()
            x, y, w, times = (b.column(k)[i].as_buffer() for k in (1, 2, 3, 5))
            at = lambda v, kind: np.frombuffer(v, kind).reshape(-1, n)
            models = [m for m, e in enumerate(excluded) if fold not in e]
            yield Batch(at(x, kind), unpacked(y, n), unpacked(w, n), None if times is None else at(times, np.uint8), models, fold)


def times_drawn(key: np.ndarray, trees: int) -> np.ndarray:
    """How often each tree's bootstrap takes each row: Poisson counts from hashes of tree and key."""
    z = key.astype(np.int64).view(np.uint64)[:, None] ^ (np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None]
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(odd)
    u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / 2.0**53
    return np.searchsorted(POISSON, u, "right").astype(float)


def summed(blocked: DataFrame, excluded: Sequence[Sequence[int]], bins: int, shape: tuple[int, ...], add: Callable, fold_up: Callable | None = None, sums: int = 2) -> np.ndarray:
    """``sums`` arrays of a shape, added up over all rows. ``add(batch, totals)`` adds a block to a task's totals, a dict of
    arrays; ``fold_up(totals)`` makes the task's sums of them, by default the array "sums" that starts as zeros."""
    size = int(np.prod(shape))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {} if fold_up else {"sums": np.zeros((sums, *shape))}
        none = True
        for batch in batches_of(stream, excluded, bins):
            add(batch, totals)
            none = False
        if none:
            return
        total = (fold_up(totals) if fold_up else totals["sums"]).reshape(sums, size)
        used = np.flatnonzero(total.any(0))
        for first in range(0, len(used), 1 << 16):
            part = used[first : first + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), *(pa.array(total[s, part]) for s in range(sums))], ["cell", *(f"s{s}" for s in range(sums))])

    schema = "cell long, " + ", ".join(f"s{s} double" for s in range(sums))
    read = blocked.select("n", "x", "y", "w", "fold", "times")
    with _batches(read.sparkSession, BLOCKS_PASSED):
        table = read.mapInArrow(run, schema).groupBy("cell").agg(*[F.sum(f"s{s}").alias(f"s{s}") for s in range(sums)]).toArrow()
    out = np.zeros((sums, size))
    out[:, table["cell"].to_numpy()] = np.stack([table[f"s{s}"].to_numpy() for s in range(sums)]) if len(table) else 0
    return out.reshape(sums, *shape)


def pick_splits(g: np.ndarray, h: np.ndarray, least: float) -> tuple[np.ndarray, ...]:
    """From sums by [model, node, feature, bin]: feature (-1: none), cut bin, whether missing values go right, and the
    (g, h) sums of both sides. The first of equal gains counts: lower feature, lower cut, missing to the left."""
    models, nodes, features, bins = g.shape
    seen_g, seen_h = np.cumsum(g[..., 1:], -1)[..., :-1], np.cumsum(h[..., 1:], -1)[..., :-1]
    all_g, all_h = g[:, :, :1].sum(-1, keepdims=True), h[:, :, :1].sum(-1, keepdims=True)
    left_g = np.stack([seen_g + g[..., :1], seen_g], -1)
    left_h = np.stack([seen_h + h[..., :1], seen_h], -1)
    right_g, right_h = all_g[..., None] - left_g, all_h[..., None] - left_h
    gain = left_g**2 / (left_h + SHRINK) + right_g**2 / (right_h + SHRINK) - (all_g**2 / (all_h + SHRINK))[..., None]
    gain = np.where((left_h >= least) & (right_h >= least), gain, -np.inf)
    flat = gain.reshape(models, nodes, -1)
    # Sums come in any order: gains that differ by rounding alone count as equal.
    top = flat.max(-1, keepdims=True) if flat.shape[-1] else np.full((models, nodes, 1), -np.inf)
    best = np.argmax(flat >= top - 1e-9 * np.abs(top), -1) if flat.shape[-1] else np.zeros((models, nodes), int)
    f, cut, right = np.unravel_index(best, (features, max(bins - 2, 1), 2))
    split = top[..., 0] > 1e-9
    m, n = np.indices((models, nodes))
    side = lambda a, whole, other: np.where(split, a[m, n, f, cut, right], other * whole[:, :, 0, 0])
    sides = (side(left_g, all_g, 1), side(left_h, all_h, 1), side(right_g, all_g, 0), side(right_h, all_h, 0))
    return np.where(split, f, -1), cut + 1, right.astype(bool), *sides


def _histograms(models: int, widths: Sequence[int], nodes: int, bins: int, of_row: Callable, counted: np.ndarray | None = None) -> tuple[Callable, Callable]:
    """``add`` and ``fold_up`` of sums by [model, feature, node, bin]; ``of_row(batch, m)`` gives rows' node and two values.
    With ``counted``, by [model, node], only rows of these nodes are summed, of which each of ``nodes`` parents has one.

    While nodes are few, features are counted in groups, in fewer passes over a block's rows, and each feature's sums are
    those of its group over the other features.
    """
    groups = grouped(widths, nodes)
    cells = [int(np.prod([widths[f] for f in g])) for g in groups]

    def add(b: Batch, totals: dict) -> None:
        for m in b.models:
            node, *values = of_row(b, m)
            node, on = node.astype(np.intp, copy=False), slice(None)
            if counted is not None:
                on = np.flatnonzero(counted[m].take(node, mode="clip"))
                node, values = node[on] >> 1, [v[on] for v in values]
            for i, (g, n) in enumerate(zip(groups, cells, strict=True)):
                cell = b.code(g, widths)[on]
                if nodes > 1:
                    cell = cell + node * n
                if (m, i) not in totals:
                    totals[m, i] = np.zeros((len(values), nodes * n))
                for s, v in enumerate(values):
                    totals[m, i][s] += np.bincount(cell, v, nodes * n)

    def fold_up(totals: dict) -> np.ndarray:
        out = np.zeros((2, models, len(widths), nodes, bins))
        for (m, i), t in totals.items():
            g = groups[i]
            t = t.reshape(2, nodes, *[widths[f] for f in g])
            for k, f in enumerate(g):
                out[:, m, f, :, : widths[f]] = t.sum(tuple(2 + j for j in range(len(g)) if j != k))
        return out

    return add, fold_up


def grow_round(blocked: DataFrame, forest: Forest, gradients: Callable, widths: Sequence[int], excluded: Sequence[Sequence[int]], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Grows one more tree of every model, a pass a level; returns the leaves' (g, h) sums. Of two nodes that a split made
    the lighter one's rows are summed, and the other's sums are what is left of the parent's."""
    forest.grow()
    r, models, n_features, bins = len(forest.feature) - 1, forest.models, len(widths), max(widths)
    for level in range(forest.depth):
        nodes, walk = 2**level, Walk(forest, r, level, widths)

        def of_row(b: Batch, m: int, walk: Walk = walk) -> tuple[np.ndarray, ...]:
            raw, node = walk(b, m)
            return node, *gradients(b, m, raw)

        parents = max(nodes // 2, 1)
        right = rh < lh if level else None
        counted = np.stack([~right, right], -1).reshape(models, nodes) if level else None
        add, fold_up = _histograms(models, widths, parents, bins, of_row, counted)
        sums = summed(blocked, excluded, bins, (models, n_features, parents, bins), add, fold_up).swapaxes(2, 3)
        if level:
            sides = np.stack([sums, whole - sums], 3)
            sums = np.where(right[None, :, :, None, None, None], sides[:, :, :, ::-1], sides).reshape(2, models, nodes, n_features, bins)
        whole = sums
        f, cut, missing_right, lg, lh, rg, rh = pick_splits(*sums, least)
        at = slice(nodes - 1, 2 * nodes - 1)
        forest.feature[r][:, at], forest.cut[r][:, at], forest.missing_right[r][:, at] = f, cut, missing_right
    return np.stack([lg, rg], -1).reshape(models, -1), np.stack([lh, rh], -1).reshape(models, -1)


def _leaf_quantiles(blocked: DataFrame, excluded, bins: int, levels: np.ndarray, leaves: int, low: float, high: float, residual: Callable) -> np.ndarray:
    """The weighted quantile of residuals in every model's leaves, from sums over a grid: the mean of the cell that reaches the level."""
    models = len(levels)

    def add(b: Batch, totals: dict) -> None:
        for m in b.models:
            value, leaf = residual(b, m)
            cell = leaf.astype(np.intp) * GRID + np.clip(((value - low) / (high - low) * GRID).astype(np.intp), 0, GRID - 1)
            w = b.weight(m)
            for s, v in enumerate((w, w * value)):
                totals["sums"][s, m] += np.bincount(cell, v, leaves * GRID).reshape(leaves, GRID)

    w, wv = summed(blocked, excluded, bins, (models, leaves, GRID), add)
    upto = np.cumsum(w, -1)
    reached = (upto >= levels[:, None, None] * upto[..., -1:] - 1e-9 * upto[..., -1:]) & (w > 0)
    at = reached.argmax(-1)[..., None]
    weight = np.take_along_axis(w, at, -1)[..., 0]
    return np.where(weight > 0, np.take_along_axis(wv, at, -1)[..., 0] / np.maximum(weight, 1e-300), 0.0)


def boosted_quantiles(stored: DataFrame, n_features: int, levels: Sequence[float], *, excluded: Sequence[int] = (), rounds: int = 8, depth: int = 3, rate: float = 0.5, bins: int = BINS, least: float = 50.0) -> Forest:
    """One boosted model a quantile level, by weighted pinball loss: gradients are the levels less the rows at or below
    the prediction, and a leaf moves by ``rate`` times the weighted quantile of its residuals. Rows of ``excluded`` folds aren't seen."""
    tau = np.array(levels, float)
    out_of = [tuple(excluded)] * len(tau)
    bounds = stored.where(~F.col("fold").isin(list(excluded))).agg(F.min("y"), F.max("y")).first()
    low, high = (float(v or 0.0) for v in bounds)
    spread = max(high - low, 1e-9)
    blocked, out_of = blocks(stored, out_of, bins, False)
    start = _leaf_quantiles(blocked, out_of, bins, tau, 1, low, low + spread, lambda b, m: (b.y, np.zeros(len(b.y), np.uint8)))[:, 0]
    forest = Forest(depth, len(tau), start)

    def gradients(b: Batch, m: int, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = b.weight(m)
        return w * (tau[m] - (b.y <= raw)), w

    for r in range(rounds):
        grow_round(blocked, forest, gradients, [bins + 1] * n_features, out_of, least)
        walk = Walk(forest, r, depth, [bins + 1] * n_features)

        def residual(b: Batch, m: int, walk: Walk = walk) -> tuple[np.ndarray, np.ndarray]:
            raw, leaf = walk(b, m)
            return b.y - raw, leaf

        forest.value[r][:] = rate * _leaf_quantiles(blocked, out_of, bins, tau, 2**depth, -spread, spread, residual)
    return forest


def boosted_probabilities(stored: DataFrame, n_features: int, *, excluded: Sequence[Sequence[int]] = ((),), rounds: int = 10, depth: int = 3, rate: float = 0.3, bins: int = BINS, least: float = 5.0, laid: tuple | None = None, widths: Sequence[int] | None = None) -> Forest:
    """Boosted log odds of a 0/1 target by Newton steps, one model for each entry of ``excluded``, which names the folds it doesn't see.
    ``laid`` are the rows' :func:`blocks`, where they are there already, ``widths`` the features' numbers of bins."""
    forest = Forest(depth, len(excluded), np.zeros(len(excluded)))
    blocked, excluded = laid or blocks(stored, excluded, bins, False)

    def gradients(b: Batch, m: int, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, w = 1 / (1 + np.exp(-raw)), b.weight(m)
        return w * (b.y - p), w * p * (1 - p)

    for r in range(rounds):
        g, h = grow_round(blocked, forest, gradients, widths or [bins + 1] * n_features, excluded, least)
        forest.value[r][:] = rate * g / (h + SHRINK)
    return forest


@dataclass
class QuantileForest:
    """Bootstrapped regression trees whose leaves keep their rows' weighted distribution over a grid of values."""

    trees: Forest
    values: np.ndarray
    shares: np.ndarray

    def quantiles(self, x: np.ndarray, levels: Sequence[float], chunk: int = 2048) -> np.ndarray:
        """A row's distribution is the mean of its leaves' distributions; its quantiles are the first values to reach the levels."""
        out = np.zeros((x.shape[1], len(levels)))
        for first in range(0, len(out), chunk):
            part = np.ascontiguousarray(x[:, first : first + chunk])
            law = np.zeros((part.shape[1], len(self.values)))
            for t in range(self.trees.models):
                law += self.shares[t][self.trees.nodes(part, 0, t, self.trees.depth)]
            upto = np.cumsum(law, 1)
            for i, level in enumerate(levels):
                at = (upto < (level - 1e-9) * upto[:, -1:]).sum(1)
                out[first : first + chunk, i] = self.values[np.minimum(at, len(self.values) - 1)]
        return out


def quantile_forest(stored: DataFrame, n_features: int, *, excluded: Sequence[int] = (), trees: int = 16, depth: int = 6, cells: int = 256, bins: int = BINS, least: float = 20.0) -> QuantileForest:
    """Trees by weighted variance, all grown together, each on its own bootstrap; then one pass for the leaves' distributions."""
    known = stored.where(~F.col("fold").isin(list(excluded)))
    cuts = cut_points(known, ["y"], cells)[0]
    forest = Forest(depth, trees, np.zeros(trees))
    out_of = [tuple(excluded)] * trees
    middle = float(known.agg(F.avg("y")).first()[0] or 0.0)
    blocked, out_of = blocks(stored, out_of, bins, True)

    def centred(b: Batch, m: int, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = b.weight(m)
        return w * (b.y - middle), w

    # Centred targets: the gain of squared sums is then that of the variance, whatever SHRINK is.
    grow_round(blocked, forest, centred, [bins + 1] * n_features, out_of, least)
    leaves, width = 2**depth, len(cuts) + 1

    def add(b: Batch, totals: dict) -> None:
        cell = np.searchsorted(cuts, b.y, "left")
        for t in b.models:
            at, w = forest.nodes(b.x, 0, t, depth).astype(np.intp) * width + cell, b.weight(t)
            for s, v in enumerate((w, w * b.y)):
                totals["sums"][s, t] += np.bincount(at, v, leaves * width).reshape(leaves, width)

    w, wy = summed(blocked, out_of, bins, (trees, leaves, width), add)
    total = w.sum((0, 1))
    values = np.where(total > 0, wy.sum((0, 1)) / np.maximum(total, 1e-300), np.concatenate([cuts, cuts[-1:] if len(cuts) else [0.0]]))
    return QuantileForest(forest, np.maximum.accumulate(values), w / np.maximum(w.sum(-1, keepdims=True), 1e-300))


def predicted(stored: DataFrame, predict: Callable[[np.ndarray], np.ndarray], name: str = "q") -> DataFrame:
    """The stored rows' y, w, fold and key, with ``predict`` of their bins (a row a feature in, a row a case out) as an array column."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            out = np.asarray(predict(bins_of(b.column(0))), float)
            offsets = np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(1, 5)), pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], ["y", "w", "fold", "key", name])

    return stored.mapInArrow(run, f"y double, w double, fold int, key long, {name} array<double>")


def pooled(weight: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Weighted isotonic means of a sequence: adjacent blocks out of order are merged. Cells without weight take the level before them."""
    blocks: list[list[float]] = []
    for i, (w, y) in enumerate(zip(weight, mean, strict=True)):
        if w > 0:
            blocks.append([w, y, i])
            while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
                w2, y2, _ = blocks.pop()
                w1, y1, first = blocks.pop()
                blocks.append([w1 + w2, (w1 * y1 + w2 * y2) / (w1 + w2), first])
    out = np.full(len(weight), blocks[0][1] if blocks else 0.5)
    for _, y, first in blocks:
        out[int(first) :] = y
    return out
