"""Quartile bucket digests of whole texts (operator 5).

A text's byte triplets are hashed into buckets; each bucket's count is coded by
the quartile it falls in (two bits), and the length by a logarithmic step. Two
digests are compared bucket by bucket with a bounded difference score.

For the neighbour query the rows meet in doc_id order without a global sort:
quantiles of doc_id cut the order into as many ranges as there are shuffle
partitions, every range gets a copy of the first row after it, and each task
walks its ranges in order. A range never holds more than its share of distinct
doc_ids, as doc_id rather than source or content decides it; rows that share a
doc_id (or have none) are walked in one task, one after the other.

Defined results: a null text is empty; an empty text has the digest of no
triplets and is like another empty text (1.0); a null doc_id sorts first;
repeated rows are walked in order of their text; texts of any length are
digested whole; an empty table gives no rows;
a table of one row is its own next document; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage

BUCKETS = 1024
#: Code differences of 0 to 3 quartiles, the largest counted double.
_STEP = np.array([0, 1, 2, 6], np.int64)
#: About what digests of unrelated long texts of one language differ by; at and beyond it likeness is 0.
_FAR = 0.8 * BUCKETS


def codes(data: bytes) -> np.ndarray:
    """One quartile code per bucket, and the length's step last."""
    if not data:
        return np.zeros(BUCKETS + 1, np.uint8)
    b = np.frombuffer(data + b"\0\0", np.uint8).astype(np.uint32)
    hashed = (b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)) * np.uint32(2654435761) >> np.uint32(33 - BUCKETS.bit_length())
    count = np.bincount(hashed, minlength=BUCKETS)
    order = np.sort(count)
    cuts = order[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    out = np.empty(BUCKETS + 1, np.uint8)
    out[:-1] = (count > cuts[0]).astype(np.uint8) + (count > cuts[1]) + (count > cuts[2])
    out[-1] = min(255, 1 + int(8 * np.log2(len(data))))
    return out


def encode(code: np.ndarray) -> str:
    """Hex: the length's step, then the buckets' codes, four to a byte."""
    q = code[:-1].reshape(-1, 4)
    packed = (q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6).astype(np.uint8)
    return bytes([code[-1]]).hex() + packed.tobytes().hex()


def decode(text: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(text), np.uint8)
    q = np.stack([raw[1:] >> s & 3 for s in (0, 2, 4, 6)], axis=1).reshape(-1)
    return np.append(q, raw[0]).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal digests, 0 for those as different as unrelated ones.

    Short texts fill few buckets, so their difference is measured by what two
    digests that share no bucket would differ by.
    """
    apart = int(_STEP[np.abs(a[:-1].astype(np.int64) - b[:-1])].sum()) + max(0, abs(int(a[-1]) - int(b[-1])) - 4)
    far = min(_FAR, float(_STEP[a[:-1]].sum() + _STEP[b[:-1]].sum()))
    return max(0.0, 1.0 - apart / far) if far else float(not apart)


def edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and fingerprint of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode(codes(t.encode())) for t in texts], pa.string())], ["doc_id", "n_chars", "fingerprint"])

    storage.small_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def _range_of(key, cuts: list[int]):
    """How many cuts lie below ``key``: first among coarse cuts, then within one stretch."""
    step = max(1, int(len(cuts) ** 0.5))
    stretches = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    coarse = F.array(*[F.lit(s[-1]).cast("long") for s in stretches])
    fine = F.array(*[F.array(*[F.lit(c).cast("long") for c in s]) for s in stretches])
    whole = F.size(F.filter(coarse, lambda c: c < key))
    inner = F.coalesce(F.size(F.filter(F.get(fine, whole), lambda c: c < key)), F.lit(0))
    return (whole * step + F.greatest(inner, F.lit(0))).cast("int")


def neighbour_fingerprints(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint, that of its edited text, and how like they and the next row's are."""
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    rows = rows.withColumn("_key", F.coalesce("doc_id", F.lit(-(2**63)).cast("long")))
    ids = rows.select("_key")
    marks = [i / n for i in range(1, n)]
    cuts = sorted({int(c) for c in ids.approxQuantile("_key", marks, max(1e-4, 1 / (8 * n)))}) if n > 1 else []
    bucket = _range_of(F.col("_key"), cuts) if cuts else F.lit(0)
    rows, ids = rows.withColumn("_range", bucket), ids.withColumn("_range", bucket)
    # One row per range, so at most as many as there are partitions.
    firsts = sorted((r[0], r[1]) for r in ids.groupBy("_range").agg(F.min("_key")).collect())
    before = [(key, firsts[i - 1][0]) for i, (_, key) in enumerate(firsts)]
    heads = F.broadcast(spark.createDataFrame(before, "_key long, _before int"))
    here = F.struct(F.col("_range").alias("r"), F.lit(0).alias("tail"))
    there = F.struct(F.col("_before").alias("r"), F.lit(1).alias("tail"))
    sent = rows.join(heads, "_key", "left").withColumn("_to", F.explode(F.when(F.col("_before").isNull(), F.array(here)).otherwise(F.array(here, there))))
    sent = sent.select(F.col("_to.r").alias("r"), F.col("_to.tail").alias("tail"), "_key", "doc_id", "text")
    parts = len(firsts) and max(r for r, _ in firsts) + 1
    sent = sent.repartitionById(max(n, parts), F.col("r")).sortWithinPartitions("r", "tail", "_key", "text")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        open_row = None  # (range, doc_id, text, codes) that waits for the text after it
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for r, tail, doc, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                text = text or ""
                code = codes(text.encode())
                if open_row and open_row[0] == r:
                    _, doc0, text0, code0 = open_row
                    changed = edited(text0, text).encode()
                    other = codes(changed)
                    values = (doc0, len(text0), hashlib.sha256(changed).hexdigest(), encode(code0), encode(other), likeness(code0, other), likeness(code0, code))
                    for out, v in zip(cols, values, strict=True):
                        out.append(v)
                open_row = None if tail else (r, doc, text, code)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    storage.small_batches(spark)
    return sent.mapInArrow(walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
