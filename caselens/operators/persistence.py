"""Persistent rates of jurisdictions: fitted components, conditional laws of coming years, exposure to tiers.

A panel has a row per jurisdiction and year, whatever the number of cases. A
jurisdiction's years are array columns, and its covariance is factored and
solved in column expressions; replicates and draws are further rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import linear, rng
from ..functions import scalars as S
from . import panel as P


def cells(df: DataFrame, years: list[int]) -> DataFrame:
    """(grp, grp_no, period, rate, v) of jurisdictions with every year: the weighted error rate in percent and its sampling variance by linearisation."""
    w, e, b = F.col("weight"), F.col("err"), F.col("base")
    sums = df.where(F.col("period").isin(years)).groupBy("grp", "grp_no", "period").agg(F.sum(w * e).alias("we"), F.sum(w * b).alias("wb"), F.sum(w * w * e * e).alias("ee"), F.sum(w * w * e * b).alias("eb"), F.sum(w * w * b * b).alias("bb"))
    r = F.col("we") / F.col("wb")
    v = 10000 * (F.col("ee") - 2 * r * F.col("eb") + r * r * F.col("bb")) / (F.col("wb") * F.col("wb"))
    rows = sums.where("wb > 0").select("grp", "grp_no", "period", F.round(100 * r, 10).alias("rate"), F.round(v, 10).alias("v"))
    return rows.withColumn("_n", F.count("*").over(W.partitionBy("grp"))).where(F.col("_n") == len(years)).drop("_n")


def moments(rows: DataFrame, by: list[str], unit: str, lags: int = 3) -> DataFrame:
    """(by, lag, n, product, noise): mean products of demeaned rates of the same unit, corrected for the mean taken off, and the mean sampling variance."""
    mean = W.partitionBy(*by, "period")
    x = rows.withColumn("x", F.col("rate") - F.avg("rate").over(mean)).withColumn("_units", F.count("*").over(mean))
    own = x.select(*by, unit, F.col("period").alias("_t"), F.col("x").alias("_x"))
    pairs = x.join(own, [*by, unit]).withColumn("lag", F.col("_t") - F.col("period")).where(F.col("lag").between(0, lags))
    product = F.avg(F.col("x") * F.col("_x") * F.col("_units") / (F.col("_units") - 1))
    out = pairs.groupBy(*by, "lag").agg(F.count("*").alias("n"), product.alias("product"))
    noise = rows.groupBy(*by).agg(F.avg("v").alias("noise"))
    return out.join(noise, by) if by else out.crossJoin(F.broadcast(noise))


def resampled(rows: DataFrame, replicates: int, seed: int) -> DataFrame:
    """``rows`` with a replicate and a slot: in every replicate, as many jurisdictions as there are, drawn with replacement by index."""
    # One row per jurisdiction: their number is that of the panel's units, not of cases.
    units = rows.select("grp").distinct().withColumn("_i", F.row_number().over(W.orderBy("grp")) - 1)
    n = units.agg(F.count("*").alias("_n"))
    slots = n.select("_n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")).withColumn("slot", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    u = rng.uniform(F.lit(seed).cast("long"), F.col("replicate").cast("long") * F.col("_n") + F.col("slot"))
    picks = slots.select("replicate", "slot", F.floor(u * F.col("_n")).alias("_i"))
    return picks.join(units, "_i").drop("_i").join(rows, "grp")


def histories(rows: DataFrame, last: int) -> DataFrame:
    """A row per jurisdiction: arrays t, x (demeaned by year) and v of its years up to ``last``."""
    x = rows.where(F.col("period") <= last).withColumn("x", F.col("rate") - F.avg("rate").over(W.partitionBy("period")))
    years = F.sort_array(F.collect_list(F.struct("period", "x", "v")))
    one = x.groupBy("grp").agg(years.alias("_y"))
    pick = lambda name: F.transform("_y", lambda r: r[name])
    return one.select("grp", F.transform("_y", lambda r: r["period"].cast("double")).alias("t"), pick("x").alias("x"), pick("v").alias("v"))


def conditional_law(history: DataFrame, fit: DataFrame, horizon: list[int]) -> DataFrame:
    """(grp, x, v, mean, factor): the law of the demeaned rates of coming years given a jurisdiction's history under the
    fitted components (rho, fixed, drifting): means, and the factor of their covariance."""
    c = F.col
    law = lambda a, b: c("fixed") + c("drifting") * F.pow(c("rho"), F.abs(a - b))
    n = F.sequence(F.lit(0), F.size("t") - 1)
    covariance = F.transform(n, lambda i: F.transform(n, lambda j: law(F.get("t", i), F.get("t", j)) + F.when(i == j, F.get("v", i)).otherwise(0.0)))
    ahead = F.array(*[F.lit(float(h)) for h in horizon])
    rows = history.crossJoin(F.broadcast(fit.select("rho", "fixed", "drifting"))).withColumn("_l", linear.cholesky(covariance))
    rows = rows.withColumn("_z", linear.forward(c("_l"), c("x"))).withColumn("_c", F.transform(ahead, lambda h: linear.forward(c("_l"), F.transform("t", lambda t: law(t, h)))))
    k = F.sequence(F.lit(0), F.lit(len(horizon) - 1))
    left = F.transform(k, lambda i: F.transform(k, lambda j: law(F.get(ahead, i), F.get(ahead, j)) - linear.dot(F.get("_c", i), F.get("_c", j)) + F.when(i == j, 1e-9).otherwise(0.0)))
    return rows.select("grp", "x", "v", F.transform("_c", lambda y: linear.dot(y, c("_z"))).alias("mean"), linear.cholesky(left).alias("factor"))


def scores(predicted: DataFrame, target: DataFrame, predictions: dict[str, Column]) -> DataFrame:
    """(method, n, mae, rmse, corr) of several predictions of a jurisdiction's target (grp, y)."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("method"), p.alias("p")) for n, p in predictions.items()])).alias("m")
    rows = predicted.join(target, "grp").select("y", each).select("y", "m.*")
    gap = F.col("p") - F.col("y")
    return rows.groupBy("method").agg(F.count("*").alias("n"), F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.coalesce(F.try_divide(F.covar_pop("p", "y"), F.stddev_pop("p") * F.stddev_pop("y")), F.lit(0.0)).alias("corr"))


def exposure(law: DataFrame, anchors: DataFrame, horizon: list[int], draws: int) -> DataFrame:
    """(grp, year, draw, rate, unclipped, share): drawn paths, moved so that the first year's mean is the jurisdiction's
    anchor, with a sampling deviate at its last year's standard error, floored at 0, and their tiers.

    ``anchors``: (grp, seed, anchor). Deviates are computed by index from the seed.
    """
    c, k = F.col, len(horizon)
    per = 2 * k - 1
    deviate = lambda i: S.normal_of(rng.uniform(c("seed"), (c("draw") * per + i) * 2 + 1), rng.uniform(c("seed"), (c("draw") * per + i) * 2 + 2))
    rows = law.join(anchors, "grp").withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))))
    rows = rows.withColumn("_z", F.transform(F.sequence(F.lit(0), F.lit(per - 1)), lambda i: deviate(i.cast("long"))))
    se = F.sqrt(F.element_at("v", -1))
    path = lambda h: c("anchor") + F.get("mean", F.lit(h)) - F.get("mean", F.lit(0)) + linear.dot(F.get("factor", F.lit(h)), F.slice("_z", 1, h + 1)) + F.get("_z", F.lit(k + h - 1)) * se
    years = F.inline(F.array(*[F.struct(F.lit(horizon[h]).alias("year"), path(h).alias("unclipped")) for h in range(1, k)]))
    out = rows.select("grp", "draw", years).withColumn("rate", F.greatest(c("unclipped"), F.lit(0.0)))
    return out.withColumn("share", S.tier(c("rate")))
