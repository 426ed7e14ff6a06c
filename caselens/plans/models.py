"""Panel estimation, calibration, imputation and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import impute as I
from ..operators import panel as P
from ..operators import rates as R
from ..sources.cases import cases, table
from ..sources.shared import store
from .registry import panel, query, with_tables

c = F.col
TREATED = "NATION_7"
PRE, POST = [1995, 1996, 1997], [1998, 1999, 2000]


def _shares(spark, d):
    """Over- and underpayment rates of the groups with every period."""
    p = P.panel(cases(spark, d), "grp", "period", "weight", "base", {"over": c("status") == 2, "under": c("status") == 3})
    return P.balanced(p.where("period <= 2000"), "grp", "period")


@query("opt01_synthetic_control")
def opt01(spark, d):
    return P.synthetic_controls(_shares(spark, d), "grp", "period", ["over", "under"], [TREATED], PRE).select("unit", "period", "outcome", F.round("gap", 5).alias("gap"))


@query("opt02_gap_effects")
def opt02(spark, d):
    gaps = P.synthetic_controls(_shares(spark, d), "grp", "period", ["over", "under"], [TREATED], PRE)
    e = P.gap_effects(gaps, PRE, POST)
    return e.select("unit", "outcome", *[F.round(n, 5).alias(n) for n in ("rmspe", "pre_gap", "post_gap", "effect")])


@query("opt03_placebo_inference")
def opt03(spark, d):
    rows = _shares(spark, d)
    # One name per group of the panel: their number is that of the jurisdictions.
    units = [r[0] for r in rows.select("grp").distinct().orderBy("grp").collect()]
    e = P.gap_effects(P.synthetic_controls(rows, "grp", "period", ["over", "under"], units, PRE), PRE, POST)
    return P.placebo_p(e, TREATED).select("outcome", F.round("p", 6).alias("p"), F.round("effect", 5).alias("effect"))


@query("opt04_family_signal", "SELECT period, min(rate) < 5 AND max(rate) > 5 AS mixed, count(*) AS n, CASE WHEN avg(rate) < 10.0 / 3 THEN 'strong' WHEN avg(rate) < 10 THEN 'weak' ELSE 'none' END AS signal FROM panel GROUP BY period")
def opt04(spark, d):
    m = F.avg("rate")
    return panel(spark, d).groupBy("period").agg(((F.min("rate") < 5) & (F.max("rate") > 5)).alias("mixed"), F.count("*").alias("n"), F.when(m < 10.0 / 3, "strong").when(m < 10, "weak").otherwise("none").alias("signal"))


_FIT = """dm AS (SELECT grp, period, rate - avg(rate) OVER (PARTITION BY period) AS x FROM panel),
lagp AS (SELECT b.period - a.period AS lag, CAST(count(*) AS DOUBLE) AS n, avg(a.x * b.x) AS product FROM dm a JOIN dm b ON a.grp = b.grp AND b.period >= a.period AND b.period - a.period <= 3 GROUP BY 1),
pts AS (SELECT i / CAST(20 AS DOUBLE) AS rho, n, CASE WHEN lag = 0 THEN product - 1 ELSE product END AS y, pow(i / CAST(20 AS DOUBLE), lag) AS x FROM lagp, range(1, 20) t(i)),
sm AS (SELECT rho, sum(n) AS w, sum(n * x) AS wx, sum(n * y) AS wy, sum(n * x * x) AS wxx, sum(n * x * y) AS wxy, sum(n * y * y) AS wyy FROM pts GROUP BY rho),
ab AS (SELECT *, (w * wxy - wx * wy) / (w * wxx - wx * wx) AS b FROM sm),
ab2 AS (SELECT *, (wy - b * wx) / w AS a FROM ab),
cl AS (SELECT *, CASE WHEN a >= 0 AND b >= 0 THEN a WHEN a < 0 THEN CAST(0 AS DOUBLE) ELSE greatest(CAST(0 AS DOUBLE), wy / w) END AS fixed, CASE WHEN a >= 0 AND b >= 0 THEN b WHEN a < 0 THEN greatest(CAST(0 AS DOUBLE), wxy / wxx) ELSE CAST(0 AS DOUBLE) END AS drifting FROM ab2),
er AS (SELECT *, wyy - 2 * fixed * wy - 2 * drifting * wxy + fixed * fixed * w + 2 * fixed * drifting * wx + drifting * drifting * wxx AS sse FROM cl)"""


@query("opt05_variance_components", with_tables(_FIT, "SELECT rho, round(fixed, 5) AS fixed, round(drifting, 5) AS drifting FROM er ORDER BY round(sse, 9), rho LIMIT 1"))
def opt05(spark, d):
    x = P.demeaned(panel(spark, d), "period", "rate", "x")
    products = P.lag_products(x, "grp", "period", "x", [0, 1, 2, 3])
    fit = P.persistence_fit(products, spark.range(1).select(F.lit(1.0).alias("noise")), 19)
    return fit.select("rho", F.round("fixed", 5).alias("fixed"), F.round("drifting", 5).alias("drifting"))


@query("opt06_conditional_path")
def opt06(spark, d):
    return P.conditional_path(panel(spark, d), "grp", "period", "rate", 1).select("grp", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query("opt07_raking")
def opt07(spark, d):
    """Weights raked to 10 percent more weight on overpayments and 5 percent fewer dollars."""
    # Every step reads the three columns that it needs, from files.
    rows = store(cases(spark, d).select("status", "weight", (c("base") / 1e5).alias("k")), "raked")
    w = c("weight")
    goal = rows.agg(F.sum(w), F.sum(F.when(c("status") == 2, w)), F.sum(w * c("k"))).first()
    margins = {"all": (F.lit(1.0), goal[0]), "over": ((c("status") == 2).cast("double"), 1.1 * goal[1]), "dollars": (c("k"), 0.95 * goal[2])}
    raked, _ = I.rake(rows, "weight", margins)
    r = c("raked")
    return raked.groupBy("status").agg(F.round(F.sum(r), 3).alias("weight"), F.round(F.sum(r) * F.sum(r) / F.sum(r * r), 2).alias("n_eff"), F.round(F.max(r / w), 5).alias("most"))


@query("opt08_power_table", "SELECT delta, round(avg(CASE WHEN rate + delta >= 10 THEN 1.0 ELSE 0.0 END), 8) AS power FROM panel, (VALUES (CAST(0 AS DOUBLE)), (CAST(1 AS DOUBLE)), (CAST(2 AS DOUBLE)), (CAST(4 AS DOUBLE))) t(delta) GROUP BY delta")
def opt08(spark, d):
    from ..operators.windows import priced_shifts

    return priced_shifts(panel(spark, d), [0.0, 1.0, 2.0, 4.0], "rate", [10.0]).select(c("shift").alias("delta"), F.round("share", 8).alias("power"))


@query("opt09_step_solver", "SELECT case_id, CAST(ceil(greatest(CAST(0 AS DOUBLE), base / 100 - 600) / 3) AS BIGINT) AS steps, round(base / 100 - 3 * ceil(greatest(CAST(0 AS DOUBLE), base / 100 - 600) / 3), 6) AS reached FROM cases")
def opt09(spark, d):
    # Steps of 3 until the amount is at most 600: a monotone rule, so their number is a quotient.
    steps = F.ceil(F.greatest(F.lit(0.0), c("base") / 100 - 600) / 3)
    return cases(spark, d).select("case_id", steps.alias("steps"), F.round(c("base") / 100 - 3 * steps, 6).alias("reached"))


@query("opt10_roster", "SELECT grp, period, CASE WHEN rate < 10 THEN 'below' ELSE 'above' END AS side, abs(rate - 10) <= 1 AS near FROM panel WHERE abs(rate - 10) <= 2")
def opt10(spark, d):
    r = c("rate")
    return panel(spark, d).where(F.abs(r - 10) <= 2).select("grp", "period", F.when(r < 10, "below").otherwise("above").alias("side"), (F.abs(r - 10) <= 1).alias("near"))


@query(
    "opt11_ladder",
    "SELECT grp, round(sum(weight * CASE WHEN amount > 1500 THEN amount ELSE 0 END) * 100 / sum(weight * base) - sum(weight * CASE WHEN amount > 1000 THEN amount ELSE 0 END) * 100 / sum(weight * base), 6) + 0.0 AS threshold_step, round(sum(weight * CASE WHEN amount > 1500 THEN amount ELSE 0 END) * 100 / sum(weight * base * CAST(1.1 AS DOUBLE)) - sum(weight * CASE WHEN amount > 1500 THEN amount ELSE 0 END) * 100 / sum(weight * base), 6) + 0.0 AS price_step FROM cases GROUP BY grp",
)
def opt11(spark, d):
    over = lambda t: F.when(c("amount") > t, c("amount")).otherwise(0.0)
    g = cases(spark, d).groupBy("grp").agg(R.weighted_ratio("weight", over(1000), "base").alias("a"), R.weighted_ratio("weight", over(1500), "base").alias("b"), R.weighted_ratio("weight", over(1500), c("base") * 1.1).alias("e"))
    return g.select("grp", (F.round(c("b") - c("a"), 6) + 0.0).alias("threshold_step"), (F.round(c("e") - c("b"), 6) + 0.0).alias("price_step"))


_FEATURES = ["base_k", "discount", "score", "line", "weight"]


def _features(spark, d):
    return cases(spark, d).select("case_id", (c("base") / 1000).alias("base_k"), "discount", "score", c("line").cast("double").alias("line"), "weight", (c("err") > 0).cast("double").alias("label"), F.ln(1 + c("amount")).alias("size"), I.fold_of(c("case_id"), 4).alias("fold"))


@query("ml01_boosted_classifier")
def ml01(spark, d):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from ..operators.windows import ranking_metrics

    # The fit reads its rows in every one of its jobs: from files, the features alone.
    narrow = store(_features(spark, d).select(*_FEATURES, "label", "fold"), "features")
    rows = VectorAssembler(inputCols=_FEATURES, outputCol="features").transform(narrow)
    fit = GBTClassifier(labelCol="label", weightCol="weight", maxIter=5, maxDepth=4, seed=1).fit(rows.where("fold <> 0"))
    held = fit.transform(rows.where("fold = 0")).select(F.lit("held out").alias("part"), vector_to_array("probability")[1].alias("p"), "label", "weight")
    return ranking_metrics(held, ["part"], "p", "label", "weight").select("part", F.round("auc", 4).alias("auc"), F.round("average_precision", 4).alias("average_precision"))


@query("ml02_isotonic_by_fold")
def ml02(spark, d):
    """Scores calibrated by isotonic regression on the other folds."""
    from functools import reduce

    from pyspark.ml.regression import IsotonicRegression

    # Equal scores are one point of the fit: their weights and weighted labels are summed first, in one pass over the cases.
    sums = _features(spark, d).groupBy("fold", "score").agg(F.count("*").alias("n"), F.sum("weight").alias("w"), F.sum(c("weight") * c("label")).alias("wy"))
    points = store(sums.withColumn("label", c("wy") / c("w")), "points")
    parts = [IsotonicRegression(featuresCol="score", labelCol="label", weightCol="w").fit(points.where(c("fold") != k)).transform(points.where(c("fold") == k)) for k in range(4)]
    return reduce(lambda a, b: a.unionAll(b), parts).groupBy("fold").agg(F.sum("n").alias("n"), F.round(R.weighted_mean("prediction", "w"), 4).alias("predicted"), F.round(R.weighted_mean("label", "w"), 4).alias("observed"))


@query("ml03_smearing", "SELECT grp, round(sum(weight * exp(ln(1 + amount) - 7)) / sum(weight), 6) AS smear FROM cases WHERE amount > 0 GROUP BY grp")
def ml03(spark, d):
    return cases(spark, d).where("amount > 0").groupBy("grp").agg(F.round(R.weighted_mean(F.exp(F.ln(1 + c("amount")) - 7), "weight"), 6).alias("smear"))


@query(
    "ml04_cell_quantiles",
    with_tables(
        "wq AS (SELECT line, status, amount, sum(weight) AS w FROM cases WHERE amount > 0 GROUP BY 1, 2, 3), wq2 AS (SELECT *, sum(w) OVER (PARTITION BY line, status ORDER BY amount ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY line, status) AS total FROM wq)",
        "SELECT line, status, p AS level, round(min(amount), 8) AS value FROM wq2, (VALUES (CAST(0.05 AS DOUBLE)), (CAST(0.25 AS DOUBLE)), (CAST(0.5 AS DOUBLE)), (CAST(0.75 AS DOUBLE)), (CAST(0.95 AS DOUBLE))) t(p) WHERE upto >= p * total GROUP BY line, status, p",
    ),
)
def ml04(spark, d):
    from ..operators.windows import weighted_quantiles

    q = weighted_quantiles(cases(spark, d).where("amount > 0"), ["line", "status"], "amount", "weight", [0.05, 0.25, 0.5, 0.75, 0.95])
    return q.select("line", "status", "level", F.round("value", 8).alias("value"))


@query("ml07_gate_table", "SELECT period, round(avg(rate), 6) AS rate, avg(rate) <= (SELECT avg(rate) FROM panel) AS passes FROM panel GROUP BY period")
def ml07(spark, d):
    p = panel(spark, d)
    bar = p.agg(F.avg("rate").alias("bar"))
    return p.groupBy("period").agg(F.avg("rate").alias("x")).crossJoin(F.broadcast(bar)).select("period", F.round("x", 6).alias("rate"), (c("x") <= c("bar")).alias("passes"))


@query("ml08_permutation_importance")
def ml08(spark, d):
    """How much the weighted AUC of a fixed score falls when a feature's values are dealt anew."""
    from ..functions import rng
    from ..operators.windows import ranking_metrics

    rows = cases(spark, d).select("case_id", "grp", "score", "discount", "weight", (c("err") > 0).cast("double").alias("y"))
    rows = store(rows, "dealt")
    from pyspark.sql import Window as W

    by_key, by_hash = W.partitionBy("grp").orderBy("case_id"), W.partitionBy("grp").orderBy(rng.hash_uniform(F.lit("deal"), c("case_id")), "case_id")
    seat = rows.withColumn("i", F.row_number().over(by_key)).withColumn("j", F.row_number().over(by_hash))
    dealt = seat.select("grp", c("j").alias("i"), *[c(f).alias(f"new_{f}") for f in ("score", "discount")])
    both = seat.join(dealt, ["grp", "i"])
    whole = both.select(F.explode(F.array(F.struct(F.lit("none").alias("feature"), (c("score") + c("discount")).alias("s")), F.struct(F.lit("score").alias("feature"), (c("new_score") + c("discount")).alias("s")), F.struct(F.lit("discount").alias("feature"), (c("score") + c("new_discount")).alias("s")))).alias("f"), "y", "weight")
    return ranking_metrics(whole.select("f.feature", "f.s", "y", "weight"), ["feature"], "s", "y", "weight").select("feature", F.round("auc", 6).alias("auc"))


@query("ml09_intercept_shift")
def ml09(spark, d):
    """Every group's probabilities moved to a given mean by one shift of its logits."""
    rows = store(cases(spark, d).select("grp", (c("base") / 1e4 - 5).alias("logit"), "weight"), "logits")
    shifts = I.intercept_shifts(rows, "grp", "logit", "weight", 0.3)
    p = 1 / (1 + F.exp(-(c("logit") + c("shift"))))
    return rows.join(shifts, "grp").groupBy("grp").agg(F.round(R.weighted_mean(p, "weight"), 5).alias("mean"), F.round(F.first("shift"), 5).alias("shift"))


@query("ml10_probability_metrics", "SELECT grp, round(sum(weight * pow(score * 10 - CASE WHEN err > 0 THEN 1 ELSE 0 END, 2)) / sum(weight), 6) AS brier, round(sum(weight * score * 10) / sum(weight), 6) AS mean FROM cases GROUP BY grp")
def ml10(spark, d):
    p, y = c("score") * 10, (c("err") > 0).cast("double")
    return cases(spark, d).groupBy("grp").agg(F.round(R.weighted_mean((p - y) * (p - y), "weight"), 6).alias("brier"), F.round(R.weighted_mean(p, "weight"), 6).alias("mean"))


@query("ml11_frozen_factor", "SELECT a.grp, round(b.rate / a.rate, 6) AS factor, round(a.rate * (b.rate / a.rate) - d.rate, 6) + 0.0 AS miss FROM (SELECT grp, rate FROM panel WHERE period = 1998) a JOIN (SELECT grp, rate FROM panel WHERE period = 1999) b USING (grp) JOIN (SELECT grp, rate FROM panel WHERE period = 2000) d USING (grp)")
def ml11(spark, d):
    p = panel(spark, d)
    at = lambda y, n: p.where(c("period") == y).select("grp", c("rate").alias(n))
    j = at(1998, "a").join(at(1999, "b"), "grp").join(at(2000, "e"), "grp")
    factor = c("b") / c("a")
    return j.select("grp", F.round(factor, 6).alias("factor"), (F.round(c("a") * factor - c("e"), 6) + 0.0).alias("miss"))


@query("ml12_leave_one_period", "SELECT a.period, round(avg(b.rate), 6) AS others FROM panel a JOIN panel b ON a.grp = b.grp AND a.period <> b.period GROUP BY a.period")
def ml12(spark, d):
    # Sums over all periods less the own: no pairs of periods are formed.
    p = panel(spark, d)
    whole = p.groupBy("grp").agg(F.sum("rate").alias("s"), F.count("*").alias("k"))
    j = p.join(whole, "grp")
    return j.groupBy("period").agg(F.round(F.sum(c("s") - c("rate")) / F.sum(c("k") - 1), 6).alias("others"))


@query("x14_rounding_modes", "SELECT count(*) FILTER (WHERE round(p_retailprice) = floor(p_retailprice)) AS by_floor, count(*) FILTER (WHERE round(p_retailprice) = ceil(p_retailprice)) AS by_ceil, count(*) FILTER (WHERE round(p_retailprice) = floor(p_retailprice + 0.5)) AS by_half_up FROM part")
def x14(spark, d):
    x = c("p_retailprice")
    return table(spark, d, "part").agg(F.count_if(F.round(x) == F.floor(x)).alias("by_floor"), F.count_if(F.round(x) == F.ceil(x)).alias("by_ceil"), F.count_if(F.round(x) == F.floor(x + 0.5)).alias("by_half_up"))
