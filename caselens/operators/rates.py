"""Weighted rates and metric blocks: one pass each, pre-aggregated in tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def weighted_ratio(weight, numerator, denominator) -> Column:
    """100 * sum(w * numerator) / sum(w * denominator); null without a denominator."""
    w = _c(weight)
    return F.try_divide(F.sum(w * _c(numerator)) * 100, F.sum(w * _c(denominator)))


def weighted_mean(x, weight) -> Column:
    """Over rows with a value and a positive weight; null where there are none."""
    x, w = _c(x), _c(weight)
    valid = x.isNotNull() & ~F.isnan(x) & (w > 0)
    return F.try_divide(F.sum(F.when(valid, w * x)), F.sum(F.when(valid, w)))


def effective_n(weight) -> Column:
    w = _c(weight)
    return F.try_divide(F.sum(w) * F.sum(w), F.sum(w * w))


def with_total(df: DataFrame, group: str, total: str, *aggregates: Column) -> DataFrame:
    """Every group and the total in one pass over the rows."""
    return df.rollup(group).agg(F.grouping(group).alias("_all"), *aggregates).withColumn(group, F.when(F.col("_all") == 1, F.lit(total)).otherwise(F.col(group))).drop("_all")


def metric_block(mask: Column, weight, amount, prefix: str) -> list[Column]:
    """Rows, weight, dollars and share of dollars under a mask."""
    w, a = _c(weight), _c(amount)
    dollars = F.sum(F.when(mask, w * a).otherwise(0.0))
    return [F.count_if(mask).alias(f"{prefix}_n"), F.sum(F.when(mask, w).otherwise(0.0)).alias(f"{prefix}_weight"), dollars.alias(f"{prefix}_dollars"), F.try_divide(dollars, F.sum(w * a)).alias(f"{prefix}_share")]


def draw_summary(draws: DataFrame, keys: list[str], rate: str, base: Column) -> DataFrame:
    """Tier probabilities and the bill's mean, population spread and 95th percentile over draws."""
    share = S.tier(F.col(rate))
    bill = share / 100.0 * base
    shares = [F.avg((share == s).cast("double")).alias(f"p{s}") for s in (0, 5, 10, 15)]
    return draws.groupBy(*keys).agg(*shares, F.avg(bill).alias("mean_bill"), F.stddev_pop(bill).alias("sd_bill"), F.percentile(bill, F.lit(0.95)).alias("p95_bill"))


def election(draws: DataFrame, keys: list[str], now: str, later: str, base: Column) -> DataFrame:
    """Locking this year's rate against waiting for the next: chance that waiting is no dearer, and both bills."""
    lock, wait = S.tier(F.col(now)) / 100.0 * base, S.tier(F.col(later)) / 100.0 * base
    return draws.groupBy(*keys).agg(
        F.avg((wait <= lock).cast("double")).alias("p_win"), F.avg(lock).alias("lock_bill"), F.avg(wait).alias("wait_bill"), F.avg(F.least(lock, wait)).alias("elect_bill"), F.stddev_pop(wait).alias("wait_sd"), F.avg(S.delays(F.col(later)).cast("double")).alias("p_delay")
    )


def ratio_variance(df: DataFrame, group: str, weight: str, observed: str, predicted: str) -> DataFrame:
    """Weighted rates, their ratio and its delta-method variance by group.

    The variance is a sum of squared linearised residuals; expanding the square
    makes it six sums, so one pass gives rates and variance.
    """
    w, y, p = F.col(weight), F.col(observed), F.col(predicted)
    s = df.groupBy(group).agg(F.sum(w).alias("w"), F.sum(w * y).alias("wy"), F.sum(w * p).alias("wp"), F.sum(w * w * y * y).alias("yy"), F.sum(w * w * y * p).alias("yp"), F.sum(w * w * p * p).alias("pp"))
    r = F.col("wy") / F.col("wp")
    variance = (F.col("yy") - 2 * r * F.col("yp") + r * r * F.col("pp")) / (F.col("wp") * F.col("wp"))
    return s.select(group, (F.col("wy") / F.col("w")).alias("observed"), (F.col("wp") / F.col("w")).alias("predicted"), r.alias("ratio"), F.greatest(variance, F.lit(1e-12)).alias("ratio_variance"))


def shrink(df: DataFrame, value: str, variance: str, prior: float = 1.0) -> DataFrame:
    """Empirical-Bayes factors towards a prior: the between-group variance by moments."""
    v, s2 = F.col(value), F.col(variance)
    between = df.agg(F.greatest(F.lit(0.0), F.avg((v - prior) * (v - prior)) - F.avg(s2)).alias("between"))
    t = F.col("between")
    return df.crossJoin(F.broadcast(between)).withColumn("factor", F.when(t > 0, (v * t + prior * s2) / (t + s2)).otherwise(F.lit(prior)))


def calibration(df: DataFrame, keys: list[str], predicted: str, observed: str, weight: str) -> DataFrame:
    """Weighted slope, intercept, errors and correlation of observed on predicted, by sums."""
    w, x, y = F.col(weight), F.col(predicted), F.col(observed)
    g = df.groupBy(*keys).agg(
        *[F.sum(c).alias(n) for n, c in {"w": w, "wx": w * x, "wy": w * y, "wxx": w * x * x, "wxy": w * x * y, "wyy": w * y * y, "wae": w * F.abs(y - x), "wse": w * (y - x) * (y - x)}.items()]
    )
    c = F.col
    sxy, sxx, syy = c("wxy") - c("wx") * c("wy") / c("w"), c("wxx") - c("wx") * c("wx") / c("w"), c("wyy") - c("wy") * c("wy") / c("w")
    slope = F.try_divide(sxy, sxx)
    return g.select(*keys, slope.alias("slope"), ((c("wy") - slope * c("wx")) / c("w")).alias("intercept"), (c("wae") / c("w")).alias("mae"), F.sqrt(c("wse") / c("w")).alias("rmse"), F.try_divide(sxy, F.sqrt(sxx * syy)).alias("corr"))


def histogram(df: DataFrame, x: str, low: float, high: float, bins: int) -> DataFrame:
    """Shares of rows in equal bins; values outside fall in the end bins."""
    at = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(x) - low) / (high - low) * bins))).cast("int")
    counts = df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("bin", (F.col("n") / F.col("total")).alias("share"))


def robust_spread(df: DataFrame, x: str) -> DataFrame:
    """Mean, sample variance, median and scaled median absolute deviation."""
    centre = df.agg(F.avg(x).alias("mean"), F.var_samp(x).alias("variance"), F.percentile(x, F.lit(0.5)).alias("median"))
    away = df.crossJoin(F.broadcast(centre.select("median"))).agg((F.percentile(F.abs(F.col(x) - F.col("median")), F.lit(0.5)) / 0.67449).alias("mad_sd"))
    return centre.crossJoin(away)
