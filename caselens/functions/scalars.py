"""Scalar rules of case review: tiers, suppression, rounding, features, benefit chain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A rate below each bound pays its share (percent); at or above all, the last.
TIER_BOUNDS = ((6.0, 0), (8.0, 5), (10.0, 10))
TIER_TOP = 15
#: Agency code to cause class.
CAUSE_CLASSES = {
    "client_or_fact": (1, 2, 3, 4, 7),
    "excluded_federal_match": (8,),
    "agency_or_system": (10, 12, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25),
    "no_required_action": (26,),
    "other": (99,),
}
#: Named sets of agency codes.
CODE_SETS = {"strict": (17, 19, 20), "broad": (10, 17, 19, 20, 21, 22), "software": (17, 19)}


def tier(rate: Column, bounds: tuple = TIER_BOUNDS, top: int = TIER_TOP) -> Column:
    """Half-open steps: a rate equal to a bound is in the step above it."""
    out = F.lit(top)
    for bound, share in reversed(bounds):
        out = F.when(rate < bound, share).otherwise(out)
    return F.when(rate.isNotNull(), out)


def valid_tier(rate: Column) -> Column:
    """:func:`tier`, failing on a negative, infinite, missing or not-a-number rate."""
    good = rate.isNotNull() & ~F.isnan(rate) & (rate >= 0) & (rate < float("inf"))
    return F.when(good, tier(rate)).otherwise(F.raise_error(F.lit("rate must be finite and nonnegative")).cast("int"))


def delays(rate: Column) -> Column:
    return rate * 1.5 >= 20


def lever_error(error: Column, elements: Column, suppressed: list[int], effectiveness: float) -> Column:
    """Errors shrink by the share of their distinct elements that are suppressed."""
    own = F.array_distinct(elements)
    hit = F.size(F.array_intersect(own, F.array(*[F.lit(s) for s in suppressed])))
    return F.when((error == 0) | (F.size(own) == 0), error).otherwise(error * (1 - effectiveness * hit / F.size(own)))


def targeted_error(error: Column, in_group: Column, effectiveness: float) -> Column:
    if not 0 <= effectiveness <= 1:
        raise ValueError("effectiveness must be within [0, 1]")
    return F.when(in_group, error * (1 - effectiveness)).otherwise(error)


def share_cut(error: Column, n: Column, strict: Column, cut: float) -> Column:
    """Errors shrink by ``cut`` of the strict findings' share."""
    return F.when(n > 0, error * (1 - cut * strict / n)).otherwise(error)


def counted(status: Column, amount: Column, threshold: Column) -> Column:
    """An official error: over or under, and strictly above the threshold."""
    return F.coalesce(status.isin(2, 3) & (amount > threshold), F.lit(False))


def nonnegative(x: Column) -> Column:
    """Negative values of a nonnegative field stand for missing."""
    value = x.try_cast("double")
    return F.when(value >= 0, value)


def missing(x: Column) -> Column:
    return x.isNull().cast("int")


def parsed_number(text: Column) -> Column:
    """Blank and '.' are null; other text that is no number fails."""
    t = F.trim(text)
    return F.when(t.isin("", "."), None).otherwise(t.cast("double"))


def row_sum(columns: list[Column], least: int = 1) -> Column:
    """Sum of the present values; null where fewer than ``least`` are present."""
    values = [c.cast("double") for c in columns]
    there = reduce(lambda a, b: a + b, [v.isNotNull().cast("int") for v in values])
    return F.when(there >= least, reduce(lambda a, v: a + F.coalesce(v, F.lit(0.0)), values, F.lit(0.0)))


def count_positive(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(c > 0, 1).otherwise(0) for c in columns])


def any_null(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [c.isNull() for c in columns])


def band(x: Column, cuts: list[float], labels: list[str]) -> Column:
    """Left-closed bands: below the first cut, from cut to cut, from the last cut on."""
    out = F.lit(labels[-1])
    for cut, label in reversed(list(zip(cuts, labels, strict=False))):
        out = F.when(x < cut, label).otherwise(out)
    return F.when(x.isNotNull(), out)


def significant(x: Column, digits: int) -> Column:
    """Rounded to significant digits; zero stays zero."""
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * scale) / scale)


def half_even(x: Column, places: int = 0) -> Column:
    return F.bround(x, places) + 0.0


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def half_away(x: Column) -> Column:
    return (F.signum(x) * F.floor(F.abs(x) + 0.5)).cast("long")


def benefit(gross: Column, earned: Column, size: Column, shelter: Column, *, most: Column, least: Column, standard: float = 193.0, cap: float = 672.0) -> dict[str, Column]:
    """The administrative chain from gross income to a whole-dollar benefit, stage by stage."""
    adjusted = F.greatest(F.lit(0.0), gross - F.floor(0.2 * earned + 0.5) - standard)
    excess = F.least(F.lit(cap), F.greatest(F.lit(0.0), shelter - F.floor(adjusted / 2 + 0.5)))
    net = F.greatest(F.lit(0.0), F.floor(adjusted - excess + 0.5).cast("double"))
    reduction = F.ceil(0.3 * net)
    paid = F.greatest(F.when(size <= 2, least).otherwise(F.lit(0.0)), F.greatest(F.lit(0.0), most - reduction))
    return {"adjusted": adjusted, "excess_shelter": excess, "net": net, "reduction": reduction, "benefit": paid}


def benefits(gross, earned, size, shelter, most, least: float, standard: float = 193.0, cap: float = 672.0):
    """The last stage of :func:`benefit` for arrays, in tasks that walk many cases together."""
    import numpy as np

    adjusted = np.maximum(0.0, gross - np.floor(0.2 * earned + 0.5) - standard)
    excess = np.minimum(cap, np.maximum(0.0, shelter - np.floor(adjusted / 2 + 0.5)))
    net = np.maximum(0.0, np.floor(adjusted - excess + 0.5))
    return np.maximum(np.where(size <= 2, least, 0.0), np.maximum(0.0, most - np.ceil(0.3 * net)))


def first_difference(stages: list[tuple[str, Column, Column]]) -> Column:
    """The first stage, in order, whose two values differ; null where none does."""
    return F.coalesce(*[F.when(~a.eqNullSafe(b), F.lit(name)) for name, a, b in stages])


def months_back(yyyymm: Column, months: Column) -> Column:
    """YYYYMM a number of months earlier."""
    serial = F.floor(yyyymm / 100).cast("int") * 12 + yyyymm % 100 - 1 - months
    return (F.floor(serial / 12) * 100 + serial % 12 + 1).cast("int")


def fiscal_year(yyyymm: Column) -> Column:
    return (F.floor(yyyymm / 100) + F.when(yyyymm % 100 >= 10, 1).otherwise(0)).cast("int")


def normal_of(u1: Column, u2: Column) -> Column:
    """A standard normal deviate from two uniforms."""
    return F.sqrt(-2 * F.ln(F.greatest(u1, F.lit(1e-12)))) * F.cos(2 * 3.141592653589793 * u2)


def cause_class(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, codes in CAUSE_CLASSES.items():
        out = F.when(code.isin(*codes), name).otherwise(out)
    return F.when(code.isNull(), F.lit("unclassified")).otherwise(out)


def documented(code: Column) -> Column:
    """The code where it is one of a cause class, else null."""
    return F.when(code.isin(*[c for codes in CAUSE_CLASSES.values() for c in codes]), code)
