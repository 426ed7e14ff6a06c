"""Quantile-function algebra over nine log quantiles with an exponential tail."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The levels of the nine quantiles.
LEVELS = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.975, 0.99)


def monotone(q: Column, floor: float) -> Column:
    """Quantiles raised to the floor (of the amount, not its log) and put in order."""
    return F.array_sort(F.transform(q, lambda v: F.greatest(v, F.lit(math.log(floor)))))


def survival(threshold: Column, q: Column, tail: Column, levels: tuple = LEVELS) -> Column:
    """P(amount > threshold): 1 under the support, linear between quantiles (the
    right one at ties), exponential in the log beyond the last."""
    return F.when(threshold <= 0, 1.0).otherwise(_beyond(F.ln(threshold), q, tail, levels))


def _beyond(x: Column, q: Column, tail: Column, levels: tuple) -> Column:
    """P(log amount > x)."""
    n = len(levels)
    nodes = [F.get(q, F.lit(i)) for i in range(n)]
    out = F.when(x >= nodes[-1], (1 - levels[-1]) * F.exp(-(x - nodes[-1]) / tail))
    for i in range(n - 2, -1, -1):
        part = (x - nodes[i]) / (nodes[i + 1] - nodes[i])
        out = out.when((x >= nodes[i]) & (x < nodes[i + 1]), 1 - (levels[i] + part * (levels[i + 1] - levels[i])))
    return out.otherwise(1.0)


def inverse(u: Column, q: Column, tail: Column, levels: tuple = LEVELS) -> Column:
    """The log amount at level ``u``: first quantile below the levels, tail beyond them."""
    n = len(levels)
    nodes = [F.get(q, F.lit(i)) for i in range(n)]
    out = F.when(u < levels[0], nodes[0])
    for i in range(n - 1):
        part = (u - levels[i]) / (levels[i + 1] - levels[i])
        out = out.when(u < levels[i + 1], nodes[i] + part * (nodes[i + 1] - nodes[i]))
    return out.otherwise(nodes[-1] + tail * F.ln((1 - levels[-1]) / (1 - F.least(u, F.lit(1 - 1e-12)))))


def spread_about_median(q: Column, factor: Column, middle: int = 4) -> Column:
    centre = F.get(q, F.lit(middle))
    return F.transform(q, lambda v: centre + factor * (v - centre))


def at_levels(q: Column, wanted: list[float], levels: tuple = LEVELS) -> Column:
    """The quantile function at other levels, linear between the known ones, flat outside."""
    out = []
    for w in wanted:
        if w <= levels[0]:
            out.append(F.get(q, F.lit(0)))
        elif w >= levels[-1]:
            out.append(F.get(q, F.lit(len(levels) - 1)))
        else:
            i = max(j for j, v in enumerate(levels) if v <= w)
            part = (w - levels[i]) / (levels[i + 1] - levels[i])
            out.append(F.get(q, F.lit(i)) + part * (F.get(q, F.lit(i + 1)) - F.get(q, F.lit(i))))
    return F.array(*out)


def expected_above(threshold: Column, q: Column, tail: Column, cap: Column, levels: tuple = LEVELS) -> Column:
    """E[min(M, cap); min(M, cap) > threshold] of the amount M, in closed form.

    Mass below the first level sits on the first quantile; between quantiles the
    log amount is uniform, so a stretch of it adds its mass times the mean of
    exp over it; the exponential tail adds an integral that ends at the cap.
    The nodes, the bounds and their exponentials are bound once a row, so that
    the stretches only look them up: exp rises, hence exp(least(b, hi)) is the
    lesser of two known exponentials.
    """
    low, high = F.ln(F.greatest(threshold, F.lit(1e-300))), F.ln(cap)
    known = F.struct(q.alias("q"), F.transform(q, lambda v: F.exp(v)).alias("e"), low.alias("lo"), high.alias("hi"), F.exp(low).alias("elo"), F.exp(high).alias("ehi"), cap.cast("double").alias("cap"), tail.cast("double").alias("tail"))

    def total(s: Column) -> Column:
        node, power = (lambda i: F.get(s["q"], F.lit(i))), (lambda i: F.get(s["e"], F.lit(i)))
        inside = lambda i: (node(i) > s["lo"]) & (node(i) <= s["hi"])
        out = F.when(inside(0), levels[0] * power(0)).otherwise(0.0)
        for i in range(len(levels) - 1):
            a, b, mass = node(i), node(i + 1), levels[i + 1] - levels[i]
            stretch = F.when(F.least(b, s["hi"]) > F.greatest(a, s["lo"]), mass * (F.least(power(i + 1), s["ehi"]) - F.greatest(power(i), s["elo"])) / (b - a)).otherwise(0.0)
            out = out + F.when(b > a, stretch).otherwise(F.when(inside(i), mass * power(i)).otherwise(0.0))
        last = node(len(levels) - 1)
        rate = 1 - 1 / s["tail"]
        start, stop = F.greatest(last, s["lo"]), F.greatest(last, s["hi"])
        area = F.when(F.abs(rate) < 1e-9, stop - start).otherwise((F.exp(rate * stop) - F.exp(rate * start)) / rate)
        beyond = F.when(stop > start, (1 - levels[-1]) / s["tail"] * F.exp(last / s["tail"]) * area).otherwise(0.0)
        return out + beyond + s["cap"] * _beyond(s["hi"], s["q"], s["tail"], levels)

    return F.when(cap <= threshold, 0.0).otherwise(F.get(F.transform(F.array(known), total), F.lit(0)))


def isotonic(values: Column, n: int) -> Column:
    """The nearest rising sequence of ``n`` values: the largest, over starts up to a place, of the
    smallest mean from there to any end at or after it."""
    x = [F.get(values, F.lit(i)) for i in range(n)]
    mean = lambda j, k: sum(x[j + 1 : k + 1], x[j]) / float(k - j + 1)
    low = lambda j, i: F.least(*[mean(j, k) for k in range(i, n)]) if i < n - 1 else mean(j, n - 1)
    return F.array(*[F.greatest(*[low(j, i) for j in range(i + 1)]) if i else low(0, 0) for i in range(n)])
