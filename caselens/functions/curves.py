"""Piecewise-linear curves as arrays of knots, and their inverses."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def rising(values: Column) -> Column:
    """Running maxima of an array."""
    return F.aggregate(values, F.array().cast("array<double>"), lambda a, v: F.concat(a, F.array(F.greatest(v, F.coalesce(F.get(a, F.size(a) - 1), v)))))


def collapsed(x: Column, y: Column) -> Column:
    """Knots (x, y) of two arrays, x rising: of equal x the last y stays, so the curve has one value everywhere."""
    n = F.size(x)
    last = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == n - 1) | (F.get(x, i) != F.get(x, i + 1)))
    return F.transform(last, lambda i: F.struct(F.get(x, i).alias("x"), F.get(y, i).alias("y")))


def interpolated(at: Column, knots: Column, most: int = 1 << 16) -> Column:
    """The curve through ``knots`` at a point, flat beyond its ends; the stretch is found by halving, for at most ``most`` knots."""
    low, high = F.lit(0), F.size(knots) - 1

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        right = F.get(knots, middle)["x"] <= at
        return F.when(s["high"] - s["low"] <= 1, s).otherwise(F.struct(F.when(right, middle).otherwise(s["low"]).alias("low"), F.when(right, s["high"]).otherwise(middle).alias("high")))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(math.ceil(math.log2(most)))), F.struct(low.alias("low"), high.cast("int").alias("high")), halve)
    ends = F.transform(F.array(found), lambda s: F.struct(F.get(knots, s["low"]).alias("a"), F.get(knots, s["high"]).alias("b")))

    def between(e: Column) -> Column:
        a, b = e["a"], e["b"]
        inside = a["y"] + (at - a["x"]) / (b["x"] - a["x"]) * (b["y"] - a["y"])
        return F.when(at <= a["x"], a["y"]).when(at >= b["x"], b["y"]).otherwise(inside)

    return F.get(F.transform(ends, between), F.lit(0))


def turned(knots: Column) -> Column:
    """The inverse curve: knots with x and y exchanged."""
    return F.transform(knots, lambda k: F.struct(k["y"].alias("x"), k["x"].alias("y")))
