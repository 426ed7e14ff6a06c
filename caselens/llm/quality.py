"""Quality scores from random Fourier features (operator 7).

Every whole text becomes a fixed vector of statistics of its bytes, words and
lines. Random Fourier features of the standardised vector approximate a
Gaussian kernel; ridge regression on them is fitted from normal equations that
each task sums over its labelled rows and Spark adds up, so only one matrix of
FEATURES squared visits the driver. Isotonic regression over binned scores
makes the result a probability. Statistics' means and spreads come from all
documents.

Defined results: a null text is scored as an empty one; a null doc_id counts as
the text '' when folds are dealt; texts of any length are described whole;
repeated rows get a row each and train as often, repeated labels of a doc_id
count once, by the largest label; scores that tie share a level; without
labelled rows every score is 0.5; an empty table gives no rows; labels, lang,
source and doc_id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytesops, isotonic, storage

FEATURES = 192
RIDGE = 1e-3
THRESHOLD = 0.3
FOLDS = 5

_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "blank": b" \t\r\x0b\x0c",
    "line": b"\n",
    "stop": b".?",
    "comma": b",;:",
    "bang": b"!",
    "symbol": b"$%&*#@^~=+_",
    "bar": b"|/\\<>{}[]()",
    "quote": b"\"'`-",
    "wide": bytes(range(0x80, 0x100)),
    "control": bytes([*range(0, 9), *range(14, 32), 127]),
}
_MEMBER = np.zeros((256, len(_CLASSES)))
for _j, _chars in enumerate(_CLASSES.values()):
    _MEMBER[list(_chars), _j] = 1
N_STATS = len(_CLASSES) + 15


def is_held_out(doc_id: str = "doc_id", folds: int = FOLDS) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds == 0


def statistics(column: pa.Array) -> np.ndarray:
    """A row of N_STATS statistics per text."""
    buf, offs = bytesops.text_bytes(column)
    out = np.zeros((len(offs) - 1, N_STATS))
    for first, last in bytesops.row_blocks(offs):
        part, rel = buf[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
        begin, end, words = bytesops.word_spans(part, rel)
        size = (end - begin).astype(np.float64)
        hashed, _ = bytesops.word_hashes(part, rel)
        is_symbol = _MEMBER[part, 7] + _MEMBER[part, 8] + _MEMBER[part, 9] > 0
        tail = is_symbol[end - 1]
        big = (part >= 65) & (part <= 90)
        shout = big[begin] & big[np.minimum(begin + 1, end - 1)]
        newline = np.flatnonzero(part == 10)
        at = np.searchsorted(newline, rel)
        prefix = bytesops.prefix_hash(part)
        for k in range(last - first):
            a, b, w0, w1 = rel[k], rel[k + 1], words[k], words[k + 1]
            n, m = b - a, w1 - w0
            row = out[first + k]
            if not n:
                continue
            count = np.bincount(part[a:b], minlength=256)
            row[: len(_CLASSES)] = count @ _MEMBER / n
            p = count[count > 0] / n
            extra = row[len(_CLASSES) :]
            extra[0] = np.log1p(n)
            extra[1] = np.log1p(m)
            extra[2] = -(p * np.log2(p)).sum()
            if m:
                s = size[w0:w1]
                extra[3] = np.log1p(s.mean())
                extra[4] = np.log1p(s.std())
                extra[5] = np.log1p(s.max())
                extra[6] = (s <= 2).mean()
                _, seen = np.unique(hashed[w0:w1], return_counts=True)
                extra[7] = len(seen) / m
                extra[8] = seen.max() / m
                extra[9] = tail[w0:w1].mean()
                extra[10] = shout[w0:w1].mean()
                if m > 1:
                    pairs = np.unique(hashed[w0 : w1 - 1] * np.uint64(3) + hashed[w0 + 1 : w1])
                    extra[11] = len(pairs) / (m - 1)
            cuts = np.concatenate([[a], newline[at[k] : at[k + 1]] + 1, [b]])
            lines = np.diff(cuts)
            extra[12] = np.log1p(len(lines))
            extra[13] = np.log1p(lines.mean())
            extra[14] = len(np.unique(bytesops.span_hash(prefix, cuts[:-1], cuts[1:]))) / len(lines)
    return out


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    phases: np.ndarray
    solution: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.spread, -6, 6)
        waves = np.cos(z @ self.weights + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([waves, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.solution

    def score(self, stats: np.ndarray) -> np.ndarray:
        return self.levels[isotonic.bin_of(self.raw(stats), -0.5, 1.5)]


def _matrix(batch: pa.RecordBatch, at: int) -> np.ndarray:
    flat = batch.column(at).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, N_STATS)


def describe(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(np.arange(0, stats.size + 1, N_STATS, dtype=np.int32), pa.array(stats.ravel()))], ["doc_id", "stats"])

    storage.small_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, "doc_id long, stats array<double>")


def _moments(described: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, N_STATS))
        for batch in batches:
            x = _matrix(batch, 0)
            total += np.stack([np.full(N_STATS, len(x)), x.sum(0), (x * x).sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(N_STATS), pa.int32()), *(pa.array(t) for t in total)], ["i", "n", "s", "q"])

    rows = described.select("stats").mapInArrow(run, "i int, n double, s double, q double").groupBy("i").agg(F.sum("n"), F.sum("s"), F.sum("q")).collect()
    n, s, q = (np.array([r[j] for r in sorted(rows)]) for j in (1, 2, 3)) if rows else (np.zeros(N_STATS),) * 3
    n = np.maximum(n, 1)
    return s / n, np.sqrt(np.maximum(q / n - (s / n) ** 2, 1e-8))


def fit(described: DataFrame, labels: DataFrame, *, label: str = "quality", features: int = FEATURES, ridge: float = RIDGE, seed: int = 7) -> Model:
    """Learns from the labelled rows outside the held-out fold."""
    mean, spread = _moments(described)
    rng = np.random.default_rng(seed)
    model = Model(mean, spread, rng.normal(size=(N_STATS, features)) / np.sqrt(N_STATS), rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.full(isotonic.BINS, 0.5))
    known = labels.where(F.col(label).isin(0, 1) & ~is_held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("double").alias("y"))
    train = storage.materialize(described.join(known, "doc_id").select("stats", "y"), "train")
    d = features + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((d, d + 2))
        for batch in batches:
            x, y = model.features(_matrix(batch, 0)), batch.column(1).to_numpy()
            gram[:, :d] += x.T @ x
            gram[:, d] += x.T @ y
            gram[:, d + 1] += len(y)
        if gram[0, -1]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array(list(gram), pa.list_(pa.float64()))], ["i", "v"])

    def add(key, frame):
        return pd.DataFrame({"i": [key[0]], "v": [np.sum(np.stack(frame["v"].to_list()), axis=0)]})

    rows = train.mapInArrow(equations, "i int, v array<double>").groupBy("i").applyInPandas(add, "i int, v array<double>").collect()
    if not rows:
        return model
    gram = np.array([r["v"] for r in sorted(rows)])
    n = gram[0, -1]
    model.solution = np.linalg.solve(gram[:, :d] / n + ridge * np.diag([*np.ones(d - 1), 0]) / d, gram[:, d] / n)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, positive = np.zeros(isotonic.BINS), np.zeros(isotonic.BINS)
        for batch in batches:
            at = isotonic.bin_of(model.raw(_matrix(batch, 0)), -0.5, 1.5)
            total += np.bincount(at, minlength=isotonic.BINS)
            positive += np.bincount(at, batch.column(1).to_numpy(), isotonic.BINS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used]), pa.array(positive[used])], ["b", "n", "y"])

    sums = np.zeros((2, isotonic.BINS))
    for r in train.mapInArrow(binned, "b int, n double, y double").groupBy("b").agg(F.sum("n"), F.sum("y")).collect():
        sums[:, r[0]] = r[1], r[2]
    model.levels = isotonic.pool(*sums)
    return model


def scores(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, **how) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    described = storage.materialize(describe(docs), "stats")
    model = fit(described, labels, **how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(model.score(_matrix(batch, 0)))], ["doc_id", "score"])

    out = described.select("stats", "doc_id").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, **how) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns."""
    model = fit(storage.materialize(describe(docs), "stats"), labels, **how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = model.score(statistics(batch.column(batch.schema.get_field_index("text")))) >= threshold
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
