"""Counter-based randomness as column expressions: any draw by its index, in any order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MASK = 0xFFFFFFFF
#: Fixed value: the generator's increment.
_STEP = 0x6D2B79F5


def _product32(a: Column, b: Column) -> Column:
    """Low 32 bits of a product of two 32-bit numbers, by halves so that a long never overflows."""
    low = a.bitwiseAND(F.lit(0xFFFF)) * b
    high = (F.shiftrightunsigned(a, 16) * b).bitwiseAND(F.lit(0xFFFF))
    return (low + F.shiftleft(high, 16)).bitwiseAND(F.lit(_MASK))


def uniform(seed: Column, k: Column) -> Column:
    """The k-th uniform (from 1) of the 32-bit Weyl-sequence generator with this seed."""

    def step(a: Column) -> Column:
        x = _product32(a.bitwiseXOR(F.shiftrightunsigned(a, 15)), a.bitwiseOR(F.lit(1)))
        return x

    def finish(x: Column) -> Column:
        added = (x + _product32(x.bitwiseXOR(F.shiftrightunsigned(x, 7)), x.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(_MASK))
        mixed = x.bitwiseXOR(added)
        return mixed.bitwiseXOR(F.shiftrightunsigned(mixed, 14)) / F.lit(4294967296.0)

    # Nested transforms bind each stage once instead of repeating its expression.
    weyl = (seed + k * _STEP).bitwiseAND(F.lit(_MASK)).cast("long")
    stages = F.transform(F.transform(F.array(weyl), step), finish)
    return F.get(stages, F.lit(0))


def uniforms(seed: int, k):
    """:func:`uniform` for an array of indices, in tasks that hold numbers as arrays."""
    import numpy as np

    mask = np.uint64(_MASK)
    shift = lambda x, n: x >> np.uint64(n)
    a = (np.uint64(seed) + np.asarray(k).astype(np.uint64) * np.uint64(_STEP)) & mask
    x = (a ^ shift(a, 15)) * (a | np.uint64(1)) & mask
    mixed = x ^ ((x + ((x ^ shift(x, 7)) * (x | np.uint64(61)) & mask)) & mask)
    return (mixed ^ shift(mixed, 14)) / 4294967296.0


def hash_uniform(*keys: Column) -> Column:
    """A uniform from the first 32 bits of SHA-256 over the keys: the same for a unit wherever it is."""
    digest = F.sha2(F.concat_ws("|", *[k.cast("string") for k in keys]), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def text_seed(text: Column, start: int = 20260820) -> Column:
    """A 32-bit seed of a name: each character is mixed in and multiplied by a fixed prime."""
    codes = F.transform(F.filter(F.split(text, ""), lambda ch: ch != ""), lambda ch: F.ascii(ch).cast("long"))
    return F.aggregate(codes, F.lit(start).cast("long"), lambda a, x: F.pmod(a.bitwiseXOR(x) * 16777619, F.lit(1 << 32)))
