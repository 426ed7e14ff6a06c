"""Ordered operators: budgets, weighted quantiles, ranking metrics.

A group may hold any share of the rows, so no group is ordered by one window: the
order is cut into ranges first, sums per range give every range its start, and the
window runs within ranges (:func:`running_before`).
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.shared import store


def running_before(df: DataFrame, groups: list[str], order: list[Column], value: str, out: str, *, coarse: Column | None = None) -> DataFrame:
    """The sum of ``value`` over the rows of the group before each row.

    No group is sorted in one task: bins' sums are accumulated, and the window
    runs within a bin. ``coarse`` is a number that rises with the order, such as
    a bin of the leading sort key. Without it the rows are dealt by ranges of
    group and whole order, at cut points that Spark samples, so that groups of
    any size and equal leading keys are cut as well. They are stored before, as
    sampling reads them too, and after, for the sums and the window to see the
    same ranges: pass no more columns than are needed.
    """
    if coarse is None:
        ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = store(df, "ordered").repartitionByRange(ranges, *[F.asc(g) for g in groups], *order)
        binned = store(dealt.withColumn("_bin", F.spark_partition_id()), "ranges")
    else:
        binned = df.withColumn("_bin", coarse)
    sums = binned.groupBy(*groups, "_bin").agg(F.sum(value).alias("_sum"))
    upto = W.partitionBy(*groups).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*groups, "_bin", F.coalesce(F.sum("_sum").over(upto), F.lit(0.0)).alias("_start"))
    inner = W.partitionBy(*groups, "_bin").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = binned.withColumn(out, F.coalesce(F.sum(value).over(inner), F.lit(0.0))).join(starts, [*groups, "_bin"])
    return rows.withColumn(out, F.col("_start") + F.col(out)).drop("_bin", "_start")


def places(df: DataFrame, groups: list[str], order: list[Column], out: str) -> DataFrame:
    """``df`` with each row's place in its group's order, from 1."""
    return running_before(df.withColumn("_one", F.lit(1.0)), groups, order, "_one", out).withColumn(out, F.col(out).cast("long") + 1).drop("_one")


#: Rows from whose order brackets around a budget's end are read; what is inside is then counted in full.
SAMPLE_ROWS = 1_000_000


def order_key(score: str, tie: list[str]) -> Column:
    """What rises in the order of best scores first (NaN before numbers, nulls last), ties by ``tie``."""
    return F.struct(F.col(score).isNull().alias("gone"), (~F.isnan(score)).alias("number"), (-F.col(score)).alias("score"), *tie)


def slot(rule: str, share: float) -> str:
    return f"{rule}:{share!r}"


def budget_cuts(rows: DataFrame, groups: list[str], scores: dict[str, str], tie: list[str], weight: str, shares: list[float]) -> DataFrame:
    """(groups, _total, _cuts): where each ranking's budgets end. ``_cuts`` maps ``slot(rule, share)`` to the last key
    (:func:`order_key`) that starts inside the share of the group's weight, the weight before it and its own.

    Nothing is ordered whole: the order of some rows brackets every end, weights before a bracket are summed, and
    only the rows inside brackets are gathered and ordered. Counts show whether an end lies in its bracket; one
    that doesn't is looked for again without bounds. ``rows`` are read a few times and should be stored.
    """
    every = max(1, rows.count() // SAMPLE_ROWS)
    keys = {rule: order_key(s, tie) for rule, s in scores.items()}
    slots = {slot(rule, x): (rule, x) for rule in scores for x in shares}
    w, total = F.col(weight), F.col("_total")

    by = W.partitionBy(*groups, "rule")
    some = rows.where(F.pmod(F.xxhash64(*tie), F.lit(every)) == 0)
    some = some.select(*groups, w.alias("w"), F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), k.alias("key")) for r, k in keys.items()])).alias("r")).select(*groups, "w", "r.*")
    at = some.withColumn("upto", F.sum("w").over(by.orderBy("key").rowsBetween(W.unboundedPreceding, 0)) / F.sum("w").over(by))
    at = at.withColumn("spread", F.sum(F.col("w") * F.col("w")).over(by) / F.pow(F.sum("w").over(by), 2))
    slack = lambda x: 6 * F.sqrt(x * (1 - x) * F.col("spread")) + 4 * F.col("spread")
    ends = F.array(*[F.struct(F.lit(repr(x)).alias("share"), F.max(F.when(F.col("upto") <= x - slack(x), F.col("key"))).alias("low"), F.min(F.when(F.col("upto") >= x + slack(x), F.col("key"))).alias("high")) for x in shares])
    brackets = at.groupBy(*groups, "rule").agg(ends.alias("e")).select(*groups, "rule", F.inline("e"))
    brackets = brackets.select(*groups, F.concat_ws(":", "rule", "share").alias("slot"), "low", "high")

    def found(brackets: DataFrame) -> DataFrame:
        of = brackets.groupBy(*groups).agg(F.map_from_entries(F.collect_list(F.struct("slot", F.struct("low", "high")))).alias("_of"))
        both = rows.join(store(of, "brackets"), groups, "left")
        low = {s: F.element_at("_of", s)["low"] for s in slots}
        high = {s: F.element_at("_of", s)["high"] for s in slots}
        before = {s: F.coalesce(keys[r] < low[s], F.lit(False)) for s, (r, _) in slots.items()}
        inside = {s: ~before[s] & F.coalesce(keys[r] <= high[s], F.lit(True)) for s, (r, _) in slots.items()}
        starts = F.array(*[F.struct(F.lit(s).alias("slot"), F.lit(x).alias("share"), F.coalesce(F.sum(F.when(before[s], w)), F.lit(0.0)).alias("_start")) for s, (_, x) in slots.items()])
        sums = both.groupBy(*groups).agg(F.sum(w).alias("_total"), starts.alias("s")).select(*groups, "_total", F.inline("s"))
        held = both.where(functools.reduce(lambda a, b: a | b, inside.values()))
        held = held.select(*groups, w.alias("w"), F.explode(F.array(*[F.when(inside[s], F.struct(F.lit(s).alias("slot"), keys[r].alias("key"))) for s, (r, _) in slots.items()])).alias("r")).where("r IS NOT NULL")
        held = held.groupBy(*groups, F.col("r.slot").alias("slot"), F.col("r.key").alias("key")).agg(F.sum("w").alias("w"))
        run = F.coalesce(F.sum("w").over(W.partitionBy(*groups, "slot").orderBy("key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
        last = F.max(F.when(F.col("_start") + F.col("_run") < total * F.col("share"), F.struct("key", (F.col("_start") + F.col("_run")).alias("before"), "w")))
        ran = sums.join(held.withColumn("_run", run), [*groups, "slot"], "left")
        out = ran.groupBy(*groups, "slot").agg(F.first("share").alias("share"), F.first("_total").alias("_total"), F.first("_start").alias("_start"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("_held"), last.alias("cut"))
        return store(out, "cuts")

    cuts = found(brackets)
    sure = F.col("cut").isNotNull() & (F.col("_start") < total * F.col("share")) & (F.col("_start") + F.col("_held") >= total * F.col("share")) & (F.col("cut")["before"] + F.col("cut")["w"] >= total * F.col("share"))
    if cuts.where(~sure & (F.col("share") > 0)).head(1):
        doubt = cuts.where(~sure).select(*groups, "slot")
        again = found(store(brackets.join(doubt, [*groups, "slot"], "left_anti"), "brackets"))
        cuts = cuts.where(sure).unionByName(again.join(doubt, [*groups, "slot"], "left_semi"))
    return cuts.groupBy(*groups).agg(F.first("_total").alias("_total"), F.map_from_entries(F.collect_list(F.struct("slot", "cut"))).alias("_cuts"))


def inside_cut(score: str, tie: list[str], weight: str, rule: str, share: float) -> Column:
    """The fraction of a row, joined to :func:`budget_cuts`, that is inside the budget; equal keys share the end alike."""
    cut, key = F.element_at("_cuts", slot(rule, share)), order_key(score, tie)
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("_total") * share - cut["before"]) / cut["w"]))
    return F.when(F.col(weight).isNull() | (key < cut["key"]), 1.0).when(key == cut["key"], part).otherwise(0.0)


def budget_membership(df: DataFrame, groups: list[str], score: str, tie: list[str], weight: str, coverage: float) -> DataFrame:
    """The fraction of each row inside a budget of ``coverage`` of the weight, best scores first;
    only the row at the boundary is split. Pass no more columns than are needed: the rows are stored."""
    rows = store(df.withColumn("_all", F.lit(0)) if not groups else df, "budget")
    by = groups or ["_all"]
    cuts = budget_cuts(rows, by, {"score": score}, tie, weight, [coverage])
    return rows.join(cuts, by).select(*df.columns, inside_cut(score, tie, weight, "score", coverage).alias("membership"))


def weighted_quantiles(df: DataFrame, groups: list[str], x: str, weight: str, levels: list[float]) -> DataFrame:
    """(groups, level, value): the smallest x whose cumulative weight reaches level * total.

    Equal values are summed before the window, so it sorts distinct values.
    """
    sums = df.where(F.col(x).isNotNull() & (F.col(weight) > 0)).groupBy(*groups, x).agg(F.sum(weight).alias("_w"))
    upto = W.partitionBy(*groups).orderBy(x).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*groups)
    ranked = sums.withColumn("_upto", F.sum("_w").over(upto)).withColumn("_total", F.sum("_w").over(whole))
    reached = [F.min(F.when(F.col("_upto") >= p * F.col("_total"), F.col(x))).alias(f"_q{i}") for i, p in enumerate(levels)]
    rows = F.array(*[F.struct(F.lit(float(p)).alias("level"), F.col(f"_q{i}").alias("value")) for i, p in enumerate(levels)])
    return ranked.groupBy(*groups).agg(*reached).select(*groups, F.inline(rows))


#: Bins of a group's range of values in which quantiles are looked for.
VALUE_BINS = 1 << 14


def bracketed_quantiles(rows: DataFrame, groups: list[str], x: str, weight: str, levels: list[float]) -> DataFrame:
    """:func:`weighted_quantiles` of finite numbers in groups of any size: weights are summed by bins of the values' range,
    and only the bins in which a level is reached are put in order, each by itself. ``rows`` are read thrice and should be stored."""
    known = rows.where(F.col(x).isNotNull() & (F.col(weight) > 0))
    ends = known.groupBy(*groups).agg(F.min(x).alias("_low"), (F.max(x) - F.min(x)).alias("_spread"))
    bin_of = F.when(F.col("_spread") > 0, F.floor((F.col(x) - F.col("_low")) / F.col("_spread") * VALUE_BINS)).otherwise(F.lit(0)).cast("int")
    binned = known.join(store(ends, "ends"), groups).select(*groups, bin_of.alias("_bin"), F.col(x).alias("_x"), F.col(weight).alias("_w"))

    by = W.partitionBy(*groups)
    upto = F.sum("_w").over(by.orderBy("_bin").rowsBetween(W.unboundedPreceding, 0))
    bins = binned.groupBy(*groups, "_bin").agg(F.sum("_w").alias("_w")).select(*groups, "_bin", upto.alias("_upto"), (upto - F.col("_w")).alias("_start"), F.sum("_w").over(by).alias("_total"))
    hit = F.filter(F.array(*[F.when((F.col("_start") < p * F.col("_total")) & (F.col("_upto") >= p * F.col("_total")), F.lit(float(p))) for p in levels]), lambda p: p.isNotNull())
    hits = store(bins.select(*groups, "_bin", "_start", "_total", hit.alias("_levels")).where(F.size("_levels") > 0), "hits")

    inside = binned.join(hits.select(*groups, "_bin"), [*groups, "_bin"]).groupBy(*groups, "_bin", "_x").agg(F.sum("_w").alias("_w"))
    run = inside.withColumn("_run", F.sum("_w").over(W.partitionBy(*groups, "_bin").orderBy("_x").rowsBetween(W.unboundedPreceding, 0)))
    at = run.join(hits, [*groups, "_bin"]).select(*groups, "_x", (F.col("_start") + F.col("_run")).alias("_upto"), "_total", F.explode("_levels").alias("level"))
    return at.groupBy(*groups, "level").agg(F.min(F.when(F.col("_upto") >= F.col("level") * F.col("_total"), F.col("_x"))).alias("value"))


#: Parts of a sketch from which brackets around exact percentiles are read.
SKETCH = 10_000


def exact_percentiles(rows: DataFrame, wanted: dict[int, tuple[Column, float]]) -> DataFrame:
    """(level_no, value): exact interpolated percentiles, each of a column of its own.

    A sketch brackets each percentile; values below the bracket are counted, and only those inside, some thousandths
    of the rows, are grouped and put in order. Counts show whether a rank lies in its bracket; one that doesn't is
    looked for again without bounds. ``rows`` are read a few times and should be stored.
    """
    sketch = rows.agg(*[F.percentile_approx(x, [max(0.0, p - 3 / SKETCH), min(1.0, p + 3 / SKETCH)], SKETCH).alias(f"b{i}") for i, (x, p) in wanted.items()], *[F.count(x).alias(f"n{i}") for i, (x, _) in wanted.items()]).first()
    sizes = {i: sketch[f"n{i}"] for i in wanted if sketch[f"n{i}"]}
    bounds = {i: tuple(sketch[f"b{i}"]) for i in sizes}

    def ranked(bounds: dict) -> list:
        # Some levels a pass: an expression of all of them is too long a method to be compiled.
        return [r for first in range(0, len(bounds), 3) for r in some(dict(list(bounds.items())[first : first + 3])).collect()]

    def some(bounds: dict) -> DataFrame:
        # A value below its bracket counts under null, one above is dropped.
        each = [F.when(x.isNotNull() & (x <= bounds[i][1]), F.struct(F.lit(i).alias("level_no"), F.when(x >= bounds[i][0], x).alias("x"))) for i, (x, _) in wanted.items() if i in bounds]
        counts = rows.select(F.explode(F.array(*each)).alias("r")).where("r IS NOT NULL").groupBy("r.level_no", "r.x").agg(F.count("*").alias("k"))
        upto = F.sum("k").over(W.partitionBy("level_no").orderBy(F.asc_nulls_first("x")).rowsBetween(W.unboundedPreceding, 0))
        place = functools.reduce(lambda a, i: a.when(F.col("level_no") == i, F.lit((sizes[i] - 1) * wanted[i][1])), bounds, F.when(F.lit(False), F.lit(0.0)))
        r = counts.withColumn("upto", upto).withColumn("place", place)
        at = lambda f: F.min(F.when(F.col("upto") > f("place"), F.struct("upto", "x")))["x"]
        return r.groupBy("level_no").agg(F.first("place").alias("place"), at(F.floor).alias("low"), at(F.ceil).alias("high"))

    def value(r) -> float:
        low, high = math.floor(r.place), math.ceil(r.place)
        return r.low if low == high else (high - r.place) * r.low + (r.place - low) * r.high

    # One row a level: both its order statistics, or nulls where the bracket misses them.
    found = {r.level_no: value(r) for r in ranked(bounds) if r.low is not None and r.high is not None} if sizes else {}
    if missed := {i: (float("-inf"), float("nan")) for i in sizes if i not in found}:
        found |= {r.level_no: value(r) for r in ranked(missed)}
    return rows.sparkSession.createDataFrame([(i, found.get(i)) for i in wanted], "level_no int, value double")


def ranking_metrics(df: DataFrame, groups: list[str], score: str, label: str, weight: str) -> DataFrame:
    """Weighted ROC-AUC and average precision; ties in score share one step."""
    w, y = F.col(weight), F.col(label)
    steps = df.groupBy(*groups, score).agg(F.sum(w * y).alias("pos"), F.sum(w * (1 - y)).alias("neg"))
    down = W.partitionBy(*groups).orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*groups)
    r = steps.withColumn("tp", F.sum("pos").over(down)).withColumn("fp", F.sum("neg").over(down))
    r = r.withColumn("p_all", F.sum("pos").over(whole)).withColumn("n_all", F.sum("neg").over(whole))
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)) / (F.first("p_all") * F.first("n_all"))
    precision = F.sum(F.col("pos") / F.col("p_all") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return r.groupBy(*groups).agg(area.alias("auc"), precision.alias("average_precision"))


def precision_at(df: DataFrame, groups: list[str], score: str, tie: list[str], label: str, weight: str, share: float) -> DataFrame:
    """Precision and recall over whole rows: those before the cutoff weight, and the row that crosses it."""
    rows = store(df, "ranked")
    cuts = budget_cuts(rows, groups, {"score": score}, tie, weight, [share])
    top = order_key(score, tie) <= F.element_at("_cuts", slot("score", share))["key"]
    hit, w = F.col(weight) * F.col(label), F.col(weight)
    sums = rows.join(cuts, groups).groupBy(*groups).agg(F.sum(F.when(top, hit)).alias("_hit"), F.sum(F.when(top, w)).alias("_top"), F.sum(hit).alias("_pos"))
    return sums.where("_top IS NOT NULL").select(*groups, (F.col("_hit") / F.col("_top")).alias("precision"), (F.col("_hit") / F.col("_pos")).alias("recall"))


def mean_excess(df: DataFrame, groups: list[str], x: str, weight: str, levels: list[float]) -> DataFrame:
    """Weighted mean of x above its weighted quantiles, with the effective n there."""
    cuts = weighted_quantiles(df, groups, x, weight, levels)
    over = df.join(cuts, groups).where(F.col(x) > F.col("value"))
    w, e = F.col(weight), F.col(x) - F.col("value")
    return over.groupBy(*groups, "level").agg((F.sum(w * e) / F.sum(w)).alias("excess"), (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("n_eff"))


def midrank(draws: DataFrame, realised: DataFrame, keys: list[str], draw: str, value: str) -> DataFrame:
    """Where a realised value falls among draws, ties counted half."""
    d, v = F.col(draw), F.col(value)
    return draws.join(realised, keys).groupBy(*keys).agg(((F.count_if(d < v) + F.count_if(d <= v)) / (2 * F.count("*"))).alias("pit"))


def changes(df: DataFrame, groups: list[str], period: str, value: str) -> DataFrame:
    """Rows whose value differs from that of the period before."""
    before = F.lag(value).over(W.partitionBy(*groups).orderBy(period))
    return df.withColumn("before", before).where(F.col("before").isNotNull() & (F.col("before") != F.col(value)))


def cumulative_max(df: DataFrame, groups: list[str], order: str, x: str, out: str) -> DataFrame:
    return df.withColumn(out, F.max(x).over(W.partitionBy(*groups).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def first_per_group(df: DataFrame, groups: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*groups).orderBy(*order))).where(F.col("rank") <= n)


def weighted_pit(df: DataFrame, groups: list[str], u: str, weight: str) -> DataFrame:
    """Weighted mean of u and the Cramer-von Mises integral of its distribution against the uniform.

    Between neighbouring distinct values the distribution function is flat, so
    the integral is a sum of cubes' differences.
    """
    sums = df.groupBy(*groups, u).agg(F.sum(weight).alias("w"))
    whole, order = W.partitionBy(*groups), W.partitionBy(*groups).orderBy(u)
    r = sums.withColumn("total", F.sum("w").over(whole)).withColumn("below", (F.sum("w").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("w")) / F.col("total"))
    r = r.withColumn("left", F.coalesce(F.lag(u).over(order), F.lit(0.0))).withColumn("last", F.max(u).over(whole))
    cube = lambda hi, lo, c: (F.pow(hi - c, 3) - F.pow(lo - c, 3)) / 3
    piece = F.sum(cube(F.col(u), F.col("left"), F.col("below"))) + F.first(cube(F.lit(1.0), F.col("last"), F.lit(1.0)))
    return r.groupBy(*groups).agg((F.sum(F.col("w") * F.col(u)) / F.first("total")).alias("mean"), piece.alias("cvm"))


def priced_shifts(draws: DataFrame, shifts: list[float], rate: str, bounds: list[float]) -> DataFrame:
    """For many shifts at once, the share of draws at or above each bound after the shift."""
    n = F.count("*")
    cells = [(s, b, F.count_if(F.col(rate) + s >= b) / n) for s in shifts for b in bounds]
    rows = F.array(*[F.struct(F.lit(float(s)).alias("shift"), F.lit(float(b)).alias("bound"), F.col(f"_{i}").alias("share")) for i, (s, b, _) in enumerate(cells)])
    return draws.agg(*[c.alias(f"_{i}") for i, (_, _, c) in enumerate(cells)]).select(F.inline(rows))
