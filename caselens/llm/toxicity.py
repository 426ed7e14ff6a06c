"""Toxicity by nearest labelled examples (operator 9).

A bounded sample of labelled rows gives the examples (at most EXAMPLES of each
label, by a hash of doc_id) and the terms: all words, A-Z lower-cased, of at
least FLOOR examples. Document frequencies of the terms are counted over all
documents. Every document becomes a TF-IDF vector over the terms, each weighed
by 1 plus the log-likelihood ratio of its presence and the label, and its
NEIGHBOURS nearest examples by cosine are found exactly in an inverted index
whose postings are cut into blocks of examples: a block's largest weights bound
what any example in it can score. The blocks of the highest bounds are scored
first, and of the others those whose bound reaches the kth score so far.
Votes are weighted by cosine and by how far the sample thinned each label;
isotonic regression over the examples' own leave-one-out votes calibrates them.
The nearest examples are returned as evidence.

Defined results: a null text is an empty one; texts of any length are weighed
whole; texts without a term get the rate
of labelled examples without one; ties in cosine go to the smaller example
number, which doesn't depend on the label; repeated rows get a row each, and repeated labels of a doc_id count
once, by the largest label; without labelled rows every score is 0.5; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops, isotonic, storage
from .quality import is_held_out

EXAMPLES = 2048
FLOOR = 2
NEIGHBOURS = 24
THRESHOLD = 0.5
BLOCK = 32
#: Blocks that are scored before any is left out.
FIRST = 8
_SIEVE_BITS = 22


def _words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and its row."""
    hashes, first = bytesops.word_hashes(buf, offs)
    return hashes, np.repeat(np.arange(len(offs) - 1), np.diff(first))


def _terms_of(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """doc_id, and the numbers and frequencies of the sorted hashes ``known`` in each whole text."""
    # Most words are none of the terms; one look-up by a few bits rules them out.
    shift = np.uint64(64 - _SIEVE_BITS)
    maybe = np.zeros(1 << _SIEVE_BITS, bool)
    maybe[(known >> shift).astype(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = bytesops.text_bytes(batch.column(1))
            numbers, times, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], np.zeros(batch.num_rows + 1, np.int32)
            for first, last in bytesops.row_blocks(offs):
                words, rows = _words(buf[offs[first] : offs[last]], offs[first : last + 1] - offs[first])
                here = np.flatnonzero(maybe[(words >> shift).astype(np.int64)])
                slot = np.searchsorted(known, words[here])
                slot[slot == len(known)] = 0
                hit = known[slot] == words[here] if len(known) else np.zeros(len(here), bool)
                row = rows[here[hit]]
                pairs, n = np.unique(row * len(known) + slot[hit], return_counts=True)
                numbers.append((pairs % max(len(known), 1)).astype(np.int32))
                times.append(n.astype(np.int32))
                sizes[first + 1 : last + 1] = np.bincount(pairs // max(len(known), 1), minlength=last - first)
            ends = pa.array(np.cumsum(sizes, dtype=np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (numbers, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["doc_id", "terms", "times"])

    storage.small_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, "doc_id long, terms array<int>, times array<int>")


def _frequencies(every: DataFrame, n_terms: int) -> DataFrame:
    """(t, n): how many documents have each term, counted in tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=n_terms)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["t", "n"])

    return every.select("terms").mapInArrow(run, "t int, n long").groupBy("t").agg(F.sum("n").alias("n"))


def _distinct_words(docs: DataFrame) -> DataFrame:
    """A row per distinct word of each text: y, word (its hash as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = bytesops.text_bytes(batch.column(1))
            for first, last in bytesops.row_blocks(offs):
                words, rows = _words(buf[offs[first] : offs[last]], offs[first : last + 1] - offs[first])
                order = np.lexsort((words, rows))
                words, rows = words[order], rows[order]
                new = np.ones(len(words), bool)
                new[1:] = (words[1:] != words[:-1]) | (rows[1:] != rows[:-1])
                y = batch.column(0).to_numpy()[first + rows[new]]
                yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(words[new].view(np.int64))], ["y", "word"])

    return docs.select("y", "text").mapInArrow(run, "y int, word long")


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from lo to below hi of each range, and each one's range."""
    n = hi - lo
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) + (lo - np.cumsum(n) + n)[owner], owner


@dataclass
class Index:
    """Unit TF-IDF vectors of the examples as postings by term and block."""

    idf: np.ndarray
    labels: np.ndarray
    votes: np.ndarray
    ids: np.ndarray
    levels: np.ndarray
    plain: float
    cells: np.ndarray = field(default=None)
    block: np.ndarray = field(default=None)
    most: np.ndarray = field(default=None)
    starts: np.ndarray = field(default=None)
    posted: np.ndarray = field(default=None)
    weight: np.ndarray = field(default=None)

    def vector(self, terms, times) -> tuple[np.ndarray, np.ndarray]:
        terms = np.asarray(terms, np.int64)
        w = (1 + np.log(np.asarray(times, np.float64))) * self.idf[terms]
        norm = np.sqrt((w * w).sum())
        return terms, w / norm if norm else w

    def build(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        blocks, n_terms = -(-len(vectors) // BLOCK) or 1, len(self.idf)
        example = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
        term = np.concatenate([t for t, _ in vectors]) if vectors else np.zeros(0, np.int64)
        w = np.concatenate([x for _, x in vectors]) if vectors else np.zeros(0)
        cell = term * blocks + example // BLOCK
        order = np.argsort(cell, kind="stable")
        self.posted, self.weight = example[order].astype(np.int32), w[order]
        # Only blocks that a term occurs in have a cell: cells of a term, postings of a cell.
        used, first = np.unique(cell[order], return_index=True)
        self.block, self.starts = (used % blocks).astype(np.int32), np.append(first, len(order))
        self.most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.cells = np.searchsorted(used, np.arange(n_terms + 1) * blocks)

    def nearest(self, terms: np.ndarray, w: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of highest positive cosine, exactly, ties to the smaller number."""
        cell, owner = _ranges(self.cells[terms], self.cells[terms + 1])
        block, share = self.block[cell], w[owner]
        bound = np.bincount(block, weights=share * self.most[cell], minlength=1)
        best_i, best_s = np.zeros(0, np.int64), np.zeros(0)
        first = np.zeros(len(bound), bool)
        first[np.argpartition(-bound, FIRST - 1)[:FIRST] if len(bound) > FIRST else slice(None)] = True
        for some in (first, ~first):
            if len(best_s) == k:
                some &= bound >= best_s[-1] - 1e-9
            here = np.flatnonzero(some[block])
            if not len(here):
                continue
            posting, mine = _ranges(self.starts[cell[here]], self.starts[cell[here] + 1])
            got = np.bincount(self.posted[posting], weights=share[here][mine] * self.weight[posting], minlength=1)
            hits = np.flatnonzero(got > (max(best_s[-1] - 1e-9, 0) if len(best_s) == k else 0))
            hits = hits[hits != without]
            i, s = np.concatenate([best_i, hits]), np.concatenate([best_s, got[hits]])
            keep = np.lexsort((i, -np.round(s, 12)))[:k]
            best_i, best_s = i[keep], s[keep]
        return best_i, best_s

    def vote(self, near: np.ndarray, cosine: np.ndarray) -> float:
        w = self.votes[near] * cosine
        total = w.sum()
        return float((w * self.labels[near]).sum() / total) if total else -1.0

    def score(self, terms, times, known: dict) -> tuple[float, list[int]]:
        terms, times = np.asarray(terms, np.int64), np.asarray(times, np.int64)
        key = hashlib.blake2b(np.concatenate([terms, times]).tobytes(), digest_size=16).digest()
        if key not in known:
            if len(known) > 100_000:
                known.clear()
            t, w = self.vector(terms, times) if len(terms) else (np.zeros(0, np.int64), np.zeros(0))
            near, cosine = self.nearest(t, w, NEIGHBOURS) if len(t) else (np.zeros(0, np.int64), np.zeros(0))
            raw = self.vote(near, cosine)
            value = self.plain if raw < 0 else float(self.levels[isotonic.bin_of(np.array([raw]), 0.0, 1.0)[0]])
            known[key] = value, self.ids[near[:5]].tolist()
        return known[key]


def _llr(a, b, na, nb):
    """Log-likelihood ratio of a word's presence in a of na rows of one label and b of nb of the other."""

    def part(k, n, p):
        return F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0) + F.when(n - k > 0, (n - k) * F.log((n - k) / (n * (1 - p)))).otherwise(0.0)

    p = (a + b) / (na + nb)
    return F.when(p < 1, 2 * (part(a, na, p) + part(b, nb, p))).otherwise(0.0)


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", examples: int = EXAMPLES, floor: int = FLOOR) -> tuple[np.ndarray, Index | None, DataFrame | None]:
    """The terms' hashes, the index of examples, and every document's terms."""
    spark = docs.sparkSession
    train = labels.where(F.col(label).isin(0, 1) & ~is_held_out() & F.col("doc_id").isNotNull())
    train = train.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    rates = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not rates:
        return np.zeros(0, np.uint64), None, None
    order = F.xxhash64(F.lit(9), "doc_id")
    drawn = train.where("y = 1").orderBy(order, "doc_id").limit(examples).unionAll(train.where("y = 0").orderBy(order, "doc_id").limit(examples))
    # At most 2 * EXAMPLES ids: their number is bounded by the parameter.
    sample = storage.materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.max(F.coalesce("text", F.lit(""))).alias("text")), "examples")
    n = {r["y"]: float(r["n"]) for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n:
        return np.zeros(0, np.uint64), None, None
    seen = _distinct_words(sample).groupBy("word").agg(F.sum("y").cast("double").alias("a"), F.sum(1 - F.col("y")).cast("double").alias("b"))
    rated = seen.withColumn("ratio", _llr(F.col("a"), F.col("b"), F.lit(max(n.get(1, 0.0), 1e-9)), F.lit(max(n.get(0, 0.0), 1e-9))))
    chosen = rated.where(F.col("a") + F.col("b") >= floor).select("word", "ratio").toArrow()
    terms = chosen["word"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(terms)
    terms, ratio = terms[order], np.maximum(chosen["ratio"].to_numpy().astype(np.float64)[order], 0.0)

    every = storage.materialize(_terms_of(docs, terms), "terms")
    n_docs = every.count()
    df = np.zeros(len(terms))
    counted = _frequencies(every, len(terms)).toArrow()
    df[counted["t"].to_numpy()] = counted["n"].to_numpy()
    got = _terms_of(sample, terms).join(F.broadcast(sample.select("doc_id", "y")), "doc_id").toArrow().combine_chunks()
    columns = [got[c].to_pylist() for c in ("doc_id", "y")] + [[x.values.to_numpy() for x in got[c]] for c in ("terms", "times")]
    rows = [dict(zip(("doc_id", "y", "terms", "times"), r, strict=True)) for r in zip(*columns, strict=True)]
    # Alike examples share blocks, by their heaviest term; the order says nothing of the label.
    scale = np.log(1 + n_docs / (1 + df)) * (1 + ratio)
    lead = [int(r["terms"][np.argmax(scale[r["terms"]])]) if len(r["terms"]) else len(terms) for r in rows]
    mixed = bytesops.mix(np.array([r["doc_id"] for r in rows], np.int64).view(np.uint64), 9).tolist()
    rows = [rows[i] for i in sorted(range(len(rows)), key=lambda i: (lead[i], mixed[i]))]
    y = np.array([r["y"] for r in rows], np.float64)
    vote = np.where(y == 1, rates.get(1, 0) / max(n.get(1, 0), 1), rates.get(0, 0) / max(n.get(0, 0), 1))
    bare = np.array([not len(r["terms"]) for r in rows])
    plain = float(((vote * y)[bare].sum() + 0.5 * y.mean()) / (vote[bare].sum() + 1)) if bare.any() else 0.5 * y.mean()
    index = Index(scale, y, vote, np.array([r["doc_id"] for r in rows], np.int64), np.full(isotonic.BINS, 0.5), plain)
    vectors = [index.vector(r["terms"], r["times"]) for r in rows if len(r["terms"])]
    index.build(vectors)
    total, positive = np.zeros(isotonic.BINS), np.zeros(isotonic.BINS)
    for i, (t, w) in enumerate(vectors):
        raw = index.vote(*index.nearest(t, w, NEIGHBOURS, without=i))
        if raw >= 0:
            b = isotonic.bin_of(np.array([raw]), 0.0, 1.0)[0]
            total[b] += vote[i]
            positive[b] += vote[i] * y[i]
    index.levels = isotonic.pool(total, positive)
    return terms, index, every


def scores(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, **how) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (up to five examples' ids) of every row."""
    _, index, every = fit(docs, labels, **how)
    if index is None:
        out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.5).alias("score"), F.expr("cast(array() AS ARRAY<BIGINT>)").alias("evidence"))
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict = {}
            for batch in batches:
                lists = [[x.values.to_numpy() for x in batch.column(k)] for k in (1, 2)]
                got = [index.score(t, n, known) for t, n in zip(*lists, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in got]), pa.array([e for _, e in got], pa.list_(pa.int64()))], ["doc_id", "score", "evidence"])

        out = every.mapInArrow(run, "doc_id long, score double, evidence array<long>")
    return out.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
