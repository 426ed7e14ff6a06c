"""Panels of groups by period: event studies with synthetic controls, lags, persistence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def panel(df: DataFrame, group: str, period: str, weight: str, base: str, channels: dict[str, Column]) -> DataFrame:
    """Case weight, base dollars and each channel's rate per group and period."""
    w = F.col(weight)
    dollars = F.sum(w * F.col(base))
    rates = [(100 * F.sum(F.when(c, w * F.col("err")).otherwise(0.0)) / dollars).alias(n) for n, c in channels.items()]
    return df.groupBy(group, period).agg(F.count("*").alias("n"), F.sum(w).alias("weight"), dollars.alias("dollars"), *rates)


def balanced(df: DataFrame, group: str, period: str) -> DataFrame:
    """The groups that have every period of the panel."""
    periods = df.agg(F.countDistinct(period).alias("_all"))
    full = df.groupBy(group).agg(F.countDistinct(period).alias("_own")).crossJoin(F.broadcast(periods)).where("_own = _all")
    return df.join(full.select(group), group, "left_semi")


def demeaned(df: DataFrame, period: str, value: str, out: str) -> DataFrame:
    return df.withColumn(out, F.col(value) - F.avg(value).over(W.partitionBy(period)))


def lag_products(df: DataFrame, group: str, period: str, value: str, lags: list[int]) -> DataFrame:
    """(lag, n, mean product) over pairs of the same group a calendar lag apart."""
    a = df.select(group, F.col(period).alias("_p"), F.col(value).alias("_x"))
    b = df.select(group, F.col(period).alias("_q"), F.col(value).alias("_y"))
    shifted = a.withColumn("lag", F.explode(F.array(*[F.lit(k) for k in lags]))).withColumn("_q", F.col("_p") + F.col("lag"))
    return shifted.join(b, [group, "_q"]).groupBy("lag").agg(F.count("*").alias("n"), F.avg(F.col("_x") * F.col("_y")).alias("product"))


def simplex(v):
    """The nearest point with nonnegative parts that add up to one."""
    import numpy as np

    s = np.sort(v)[::-1]
    over = s - (np.cumsum(s) - 1) / np.arange(1, len(v) + 1)
    k = np.flatnonzero(over > 0)[-1] + 1
    return np.maximum(v - (s[:k].sum() - 1) / k, 0)


def control_weights(treated, donors, steps: int = 20_000, tolerance: float = 1e-10):
    """Donor weights on the simplex that best reproduce the treated unit's path, by accelerated projected gradient."""
    import numpy as np

    gram, target = donors @ donors.T, donors @ treated
    step = 1 / max(np.linalg.eigvalsh(gram)[-1], 1e-12)
    w = ahead = np.full(len(donors), 1 / len(donors))
    t = 1.0
    for _ in range(steps):
        new = simplex(ahead - step * (gram @ ahead - target))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead = new + (t - 1) / t2 * (new - w)
        done = np.abs(new - w).max() < tolerance
        w, t = new, t2
        if done:
            break
    return w


def synthetic_controls(df: DataFrame, group: str, period: str, outcomes: list[str], treated: list[str], before: list[int]) -> DataFrame:
    """For each unit named in ``treated``, a synthetic control of all other units: (unit, period, outcome, gap).

    A panel has one row per group and period, so a unit's task gets the whole
    panel, not the cases; units run in parallel. Outcomes are scaled by their
    spread over all units before the fit.
    """
    own = df.select(group, period, *outcomes)
    units = own.sparkSession.createDataFrame([(u,) for u in treated], "unit string")
    rows = own.crossJoin(F.broadcast(units))

    def fit(key, frame):
        import numpy as np
        import pandas as pd

        unit = key[0]
        pre = frame[frame[period].isin(before)]
        paths, names = [], None
        for y in outcomes:
            wide = pre.pivot(index=group, columns=period, values=y).sort_index()
            names = list(wide.index)
            paths.append(wide.to_numpy() / max(float(np.std(wide.to_numpy())), 1e-12))
        x = np.hstack(paths)
        me = names.index(unit)
        rest = [i for i in range(len(names)) if i != me]
        w = control_weights(x[me], x[rest])
        out = []
        for y in outcomes:
            wide = frame.pivot(index=group, columns=period, values=y).sort_index()
            gap = wide.to_numpy()[me] - w @ wide.to_numpy()[rest]
            out += [(unit, int(p), y, float(g)) for p, g in zip(wide.columns, gap, strict=True)]
        return pd.DataFrame(out, columns=["unit", "period", "outcome", "gap"])

    kind = T.StructType.fromDDL("unit string, period int, outcome string, gap double")
    return rows.groupBy("unit").applyInPandas(fit, kind)


def gap_effects(gaps: DataFrame, before: list[int], after: list[int]) -> DataFrame:
    """Pre-period RMSPE, mean gaps and their difference per unit and outcome."""
    pre, post = F.col("period").isin(*before), F.col("period").isin(*after)
    g = F.col("gap")
    return gaps.groupBy("unit", "outcome").agg(F.sqrt(F.avg(F.when(pre, g * g))).alias("rmspe"), F.avg(F.when(pre, g)).alias("pre_gap"), F.avg(F.when(post, g)).alias("post_gap")).withColumn("effect", F.col("post_gap") - F.col("pre_gap"))


def placebo_p(effects: DataFrame, unit: str) -> DataFrame:
    """(1 + placebos at least as large) / (1 + placebos), per outcome."""
    own = effects.where(F.col("unit") == unit).select("outcome", F.col("effect").alias("own"))
    rest = effects.where(F.col("unit") != unit)
    return rest.join(own, "outcome").groupBy("outcome").agg(((1 + F.count_if(F.abs("effect") >= F.abs("own"))) / (1 + F.count("*"))).alias("p"), F.first("own").alias("effect"))


def persistence_fit(products: DataFrame, noise: DataFrame, grid: int = 99) -> DataFrame:
    """Variance components by moments: for each correlation on a grid, the lag products are
    regressed on a constant and its powers with both parts held nonnegative; the least
    squared error wins, ties to the smaller correlation.

    ``products``: (lag, n, product), lag 0 net of sampling noise ``noise``: (noise).
    """
    return components_by(products.crossJoin(F.broadcast(noise)), [], grid)


def components_by(products: DataFrame, by: list[str], grid: int = 99) -> DataFrame:
    """:func:`persistence_fit` for every key of ``by`` at once, from (by, lag, n, product, noise): replicates are groups of one plan."""
    p = products.withColumn("y", F.when(F.col("lag") == 0, F.col("product") - F.col("noise")).otherwise(F.col("product")))
    rho = F.explode(F.transform(F.sequence(F.lit(1), F.lit(grid)), lambda i: i / float(grid + 1))).alias("rho")
    x = p.select(*by, "lag", "n", "y", rho).withColumn("x", F.pow("rho", F.col("lag")))
    w = F.col("n").cast("double")
    s = x.groupBy(*by, "rho").agg(*[F.sum(c).alias(k) for k, c in {"w": w, "wx": w * F.col("x"), "wy": w * F.col("y"), "wxx": w * F.col("x") * F.col("x"), "wxy": w * F.col("x") * F.col("y"), "wyy": w * F.col("y") * F.col("y")}.items()])
    c = F.col
    det = c("w") * c("wxx") - c("wx") * c("wx")
    s = s.withColumn("b", F.try_divide(c("w") * c("wxy") - c("wx") * c("wy"), det)).withColumn("a", (c("wy") - c("b") * c("wx")) / c("w"))
    only_b = F.greatest(F.lit(0.0), F.try_divide(c("wxy"), c("wxx")))
    only_a = F.greatest(F.lit(0.0), c("wy") / c("w"))
    s = s.withColumn("fixed", F.when((c("a") >= 0) & (c("b") >= 0), c("a")).when(c("a") < 0, 0.0).otherwise(only_a))
    s = s.withColumn("drifting", F.when((c("a") >= 0) & (c("b") >= 0), c("b")).when(c("a") < 0, only_b).otherwise(0.0))
    sse = c("wyy") - 2 * c("fixed") * c("wy") - 2 * c("drifting") * c("wxy") + c("fixed") * c("fixed") * c("w") + 2 * c("fixed") * c("drifting") * c("wx") + c("drifting") * c("drifting") * c("wxx")
    best = s.withColumn("sse", F.round(sse, 9)).groupBy(*by).agg(F.min(F.struct("sse", "rho", "fixed", "drifting")).alias("m"))
    return best.select(*by, "m.rho", "m.fixed", "m.drifting", "m.sse")


def conditional_path(df: DataFrame, group: str, period: str, value: str, ahead: int) -> DataFrame:
    """Gaussian prediction ``ahead`` periods on, from each group's own demeaned path under an
    exponential covariance; one task per group, a panel's few periods each."""
    kind = T.StructType.fromDDL(f"{group} string, mean double, sd double")

    def predict(frame):
        import numpy as np
        import pandas as pd

        f = frame.sort_values(period)
        t, y = f[period].to_numpy(float), f[value].to_numpy(float)
        far = np.abs(t[:, None] - t[None, :])
        total = max(float(y.var()), 1e-9)
        cov = total * (0.5 + 0.5 * 0.7**far) + 0.1 * total * np.eye(len(t))
        cross = total * (0.5 + 0.5 * 0.7 ** np.abs(t - (t.max() + ahead)))
        gain = np.linalg.solve(cov, cross)
        return pd.DataFrame({group: [f[group].iloc[0]], "mean": [float(y.mean() + gain @ (y - y.mean()))], "sd": [float(np.sqrt(max(total - gain @ cross, 0.0)))]})

    return df.select(group, period, value).groupBy(group).applyInPandas(predict, kind)
