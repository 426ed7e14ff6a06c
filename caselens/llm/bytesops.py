"""Vectorised kernels over the UTF-8 bytes of whole texts in an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_ODD = 0x9E3779B97F4A7C15
_BASE = 0x100000001B3
#: Of a second hash, to check the first by.
OTHER_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64; the table grows by doubling."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = 1 << max(20, int(n + 1).bit_length())
        steps = np.full(size, base, U64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = (x + U64((_ODD * (seed + 1)) & (2**64 - 1))).astype(U64, copy=False)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offset of each row (one more than rows); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def row_blocks(offs: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``most`` bytes each; a longer row stands alone."""
    first, n = 0, len(offs) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def prefix_hash(codes: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Prefix sums of (byte + 1) * base ** i, whose differences hash any substring."""
    out = np.zeros(len(codes) + 1, U64)
    np.cumsum((codes.astype(U64) + U64(1)) * powers(base, len(codes))[: len(codes)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, stops: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Position-independent hashes of [start, stop)."""
    n = len(prefix)
    return (prefix[stops] - prefix[starts]) * powers(_INVERSE if base == _BASE else pow(base, -1, 1 << 64), n)[starts]


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops of the words ``[^\\x20\\x09-\\x0D]+`` of each row, and each row's first word."""
    solid = ~SPACE[buf]
    starts, stops = solid.copy(), solid.copy()
    starts[1:] &= ~solid[:-1]
    stops[:-1] &= ~solid[1:]
    edge = offs[:-1][offs[:-1] < len(buf)]
    starts[edge] = solid[edge]
    last = offs[1:][offs[1:] > 0] - 1
    stops[last] = solid[last]
    begin, end = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    return begin, end, np.searchsorted(begin, offs)


def word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word with A-Z lower-cased, and each row's first word."""
    begin, end, first = word_spans(buf, offs)
    prefix = prefix_hash(LOWER[buf])
    return mix(span_hash(prefix, begin, end) + (end - begin).astype(U64) * U64(_ODD)), first


def shingle_sets(buf: np.ndarray, offs: np.ndarray, width: int) -> list[np.ndarray]:
    """Each row's sorted distinct hashes of ``width`` words in a row; the whole
    sequence as one where there are fewer; empty without words."""
    words, first = word_hashes(buf, offs)
    n = len(words)
    rolled = np.zeros(n, U64)
    if n >= width:
        for k in range(width):
            rolled[: n - width + 1] += mix(words[k : n - width + 1 + k], k + 1)
        rolled = mix(rolled, 99)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            short = np.zeros(1, U64)
            for k in range(b - a):
                short += mix(words[a + k : a + k + 1], k + 1)
            out.append(mix(short, int(b - a)))
        else:
            out.append(np.zeros(0, U64))
    return out
