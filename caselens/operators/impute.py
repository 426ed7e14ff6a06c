"""Imputation and calibration of weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rng
from .windows import running_before

#: Donors that a slice of a cell holds on average.
A_SLICE = 256


def hot_deck(recipients: DataFrame, donors: DataFrame, key: str, levels: list[list[str]], weight: str, value: str, seed: str) -> DataFrame:
    """Each recipient takes the value of a donor of its cell, drawn by weight with a uniform of its key.

    Levels go from fine to coarse; a recipient uses the finest level whose cell
    has donors. The draw is an interval join within the cell: donors' cumulative
    weights cut (0, 1], so one donor holds the uniform. A cell's unit interval is
    cut into as many slices as it has A_SLICE donors, and both sides are keyed by
    cell and slice: a recipient meets some A_SLICE donors, however many the cell
    has, and a large cell spreads over many tasks.
    """
    found = recipients.withColumn("_u", rng.hash_uniform(F.lit(seed), F.col(key)))
    pools = []
    for i, names in enumerate(levels):
        cell = F.concat_ws("|", *[F.col(n).cast("string") for n in names]) if names else F.lit("all")
        pool = donors.select(cell.alias("_cell"), F.col(weight).alias("_w"), F.col(value).alias("_value"), F.col(key).alias("_donor"))
        pool = running_before(pool, ["_cell"], [F.asc("_donor")], "_w", "_before")
        sums = pool.groupBy("_cell").agg(F.sum("_w").alias("_all"), F.ceil(F.count("*") / A_SLICE).alias("_slices"))
        upto = F.col("_before") + F.col("_w")
        pool = pool.join(sums, "_cell").select("_cell", "_donor", "_value", "_slices", ((upto - F.col("_w")) / F.col("_all")).alias("_lo"), (upto / F.col("_all")).alias("_hi"))
        pool = pool.withColumn("_slice", F.explode(F.sequence(F.floor(F.col("_lo") * F.col("_slices")), F.floor(F.col("_hi") * F.col("_slices"))))).drop("_slices")
        pools.append((i, cell, sums.select("_cell", "_slices"), pool))
    for i, cell, cells, _ in pools:
        has = cells.withColumnRenamed("_slices", f"_has{i}")
        found = found.withColumn("_cell", cell).join(has, "_cell", "left").drop("_cell")
    level = F.coalesce(*[F.when(F.col(f"_has{i}").isNotNull(), F.lit(i)) for i, *_ in pools])
    found = found.withColumn("level", level)
    out = []
    for i, cell, _, pool in pools:
        mine = found.where(F.col("level") == i).withColumn("_cell", cell).withColumn("_slice", F.floor(F.col("_u") * F.col(f"_has{i}")))
        out.append(mine.join(pool, ["_cell", "_slice"]).where("_u >= _lo AND _u < _hi").select(key, "level", F.col("_donor").alias("donor"), F.col("_value").alias("imputed")))
    return reduce(lambda a, b: a.unionAll(b), out)


def rake(df: DataFrame, weight: str, margins: dict[str, tuple[Column, float]], rounds: int = 30, tolerance: float = 1e-9) -> tuple[DataFrame, list[float]]:
    """Exponential calibration: weights w * exp(sum of multipliers) that meet every margin.

    Each Newton step is one aggregate of the margins' sums and cross sums, so the
    driver sees a few numbers a step whatever the rows.
    """
    import numpy as np

    names = list(margins)
    lam = np.zeros(len(names))
    goal = np.array([t for _, t in margins.values()])
    x = [c.cast("double") for c, _ in margins.values()]

    def tilted(values) -> Column:
        return F.col(weight) * F.exp(sum((c * float(v) for c, v in zip(x, values, strict=True)), F.lit(0.0)))

    for _ in range(rounds):
        w = tilted(lam)
        sums = [F.sum(w * a) for a in x] + [F.sum(w * a * b) for a in x for b in x]
        got = np.array(df.agg(*sums).first(), float)
        gap = goal - got[: len(x)]
        if np.abs(gap).max() <= tolerance * max(1.0, np.abs(goal).max()):
            break
        lam = lam + np.linalg.lstsq(got[len(x) :].reshape(len(x), len(x)), gap, rcond=None)[0]
    return df.withColumn("raked", tilted(lam)), lam.tolist()


def intercept_shift(df: DataFrame, logit: str, weight: str, goal: float, rounds: int = 40, tolerance: float = 1e-10) -> float:
    """The shift of all logits at which the weighted mean probability meets the goal.

    Newton steps kept inside a shrinking bracket, one aggregate each: as sure as
    bisection, in a few passes.
    """
    lo, hi, shift = -30.0, 30.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-(F.col(logit) + shift)))
        w = F.col(weight)
        mean, slope = df.agg(F.sum(w * p) / F.sum(w), F.sum(w * p * (1 - p)) / F.sum(w)).first()
        if abs(mean - goal) <= tolerance:
            break
        lo, hi = (shift, hi) if mean < goal else (lo, shift)
        step = shift + (goal - mean) / max(slope, 1e-12)
        shift = step if lo < step < hi else (lo + hi) / 2
    return shift


def intercept_shifts(df: DataFrame, group: str, logit: str, weight: str, goal: float, rounds: int = 40, tolerance: float = 1e-10) -> DataFrame:
    """(group, shift) for every group at once: a Newton step of all groups is one aggregate.

    Groups are jurisdictions: a row of two sums for each visits the driver, never a case.
    """
    spark, w = df.sparkSession, F.col(weight)
    state = {r[0]: (-30.0, 30.0, 0.0) for r in df.select(group).distinct().collect()}
    table = lambda: spark.createDataFrame([(g, s[2]) for g, s in state.items()], f"{group} string, shift double")
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-(F.col(logit) + F.col("shift"))))
        sums = df.join(table(), group).groupBy(group).agg((F.sum(w * p) / F.sum(w)).alias("m"), (F.sum(w * p * (1 - p)) / F.sum(w)).alias("s"))
        done = True
        for g, mean, slope in sums.collect():
            lo, hi, at = state[g]
            if abs(mean - goal) > tolerance:
                done = False
                lo, hi = (at, hi) if mean < goal else (lo, at)
                step = at + (goal - mean) / max(slope, 1e-12)
                state[g] = lo, hi, step if lo < step < hi else (lo + hi) / 2
        if done:
            break
    return table()


def fold_of(key: Column, folds: int) -> Column:
    """A stable fold by a hash of the key, independent of row order."""
    return F.pmod(F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")
