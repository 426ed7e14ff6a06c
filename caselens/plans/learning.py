"""Fitted models: quantile boosting and forests, nested cross-validation, a classifier that routes missing values."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quantiles as Q
from ..functions import rng
from ..operators import boosting as H
from ..operators import folds as V
from ..operators import rates as R
from ..operators.windows import bracketed_quantiles, ranking_metrics
from ..sources.cases import cases
from ..sources.shared import store
from .registry import query, with_tables
from .studies import _hash_sql

c = F.col
FEATURES = ["base", "discount", "score", "line", "grp_no", "period", "agency1", "agency2"]
HELD_OUT, FOLDS = 0, 5
#: Fixed value: deviations up to this many dollars are none.
TOLERANCE = 0.5


def _fold(key: str = "case_id"):
    return F.floor(rng.hash_uniform(F.lit("split"), c(key)) * FOLDS).cast("int")


def _kept(rows: DataFrame, *more: str) -> DataFrame:
    """What a fit needs of the cases, stored: bounds, medians, bins and cells read it, and the case view is made once."""
    return store(rows.select(F.xxhash64("case_id").alias("key"), "weight", "fold", *FEATURES, *more), "rows")


def _sizes(spark, d) -> DataFrame:
    """Cases that deviate, with the log of the size, and a fold by a hash of the key."""
    return _kept(cases(spark, d).where(c("amount") > TOLERANCE).withColumn("size", F.ln("amount")).withColumn("fold", _fold()), "status", "size")


def _stored(rows: DataFrame, target: str, known: DataFrame) -> DataFrame:
    cuts = H.cut_points(known, FEATURES)
    table = H.binned(rows, FEATURES, cuts, target=target, weight="weight", fold="fold", key=c("key"))
    # Read many times by tasks that compute: dealt evenly, once, in narrow rows.
    spark = rows.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return store(table.repartition(parts, "key"), "binned")


def _losses(held: DataFrame, q: str, name: str) -> DataFrame:
    """(estimator, level, loss, covered): weighted pinball loss and the weight at or below each quantile."""
    rows = F.array(*[F.struct(F.lit(p).alias("level"), V.pinball(c("y"), F.get(q, F.lit(i)), p).alias("loss"), (c("y") <= F.get(q, F.lit(i))).cast("double").alias("below")) for i, p in enumerate(Q.LEVELS)])
    one = held.select("w", F.explode(rows).alias("r")).groupBy("r.level").agg(F.sum(c("w") * c("r.loss")).alias("l"), F.sum(c("w") * c("r.below")).alias("b"), F.sum("w").alias("w"), F.count("*").alias("n"))
    return one.select(F.lit(name).alias("estimator"), "level", "n", F.round(c("l") / c("w"), 5).alias("loss"), F.round(c("b") / c("w"), 4).alias("covered"))


def _cells(rows: DataFrame) -> DataFrame:
    """Held-out rows with the training rows' weighted quantiles of their cell."""
    q = bracketed_quantiles(rows.where(c("fold") != HELD_OUT), ["line", "status"], "size", "weight", list(Q.LEVELS))
    wide = q.groupBy("line", "status").agg(F.transform(F.sort_array(F.collect_list(F.struct("level", "value"))), lambda r: r["value"]).alias("q"))
    return rows.where(c("fold") == HELD_OUT).join(wide, ["line", "status"]).select(c("size").alias("y"), c("weight").alias("w"), "q")


@query("ml04b_boosted_quantiles")
def ml04b(spark, d):
    """Nine weighted quantile regressions of log sizes, held-out loss and coverage beside those of cells' quantiles."""
    rows = _sizes(spark, d)
    stored = _stored(rows, "size", rows.where(c("fold") != HELD_OUT))
    forest = H.boosted_quantiles(stored, len(FEATURES), Q.LEVELS, excluded=[HELD_OUT])
    held = H.predicted(stored.where(c("fold") == HELD_OUT), forest.raw)
    cells = _losses(_cells(rows), "q", "cells").select("level", c("loss").alias("cell_loss"))
    return _losses(held, "q", "boosted").drop("estimator").join(cells, "level")


def _imputed(rows: DataFrame) -> tuple[DataFrame, list[float]]:
    """Missing features take the training rows' medians: what is held out teaches nothing."""
    known = rows.where(c("fold") != HELD_OUT).agg(*[F.percentile_approx(c(f).cast("double"), 0.5, 10000).alias(f) for f in FEATURES]).first()
    medians = [float(v if v is not None else 0.0) for v in known]
    return rows.withColumns({f: F.coalesce(c(f).cast("double"), F.lit(m)) for f, m in zip(FEATURES, medians, strict=True)}), medians


def _forest(rows: DataFrame) -> tuple[DataFrame, H.QuantileForest]:
    whole, _ = _imputed(rows)
    stored = _stored(whole, "size", whole.where(c("fold") != HELD_OUT))
    return stored, H.quantile_forest(stored, len(FEATURES), excluded=[HELD_OUT])


@query("ml06_quantile_forest")
def ml06(spark, d):
    """Quantiles from leaves' weighted distributions over bootstrapped trees: held-out loss and coverage by level."""
    stored, forest = _forest(_sizes(spark, d))
    held = H.predicted(stored.where(c("fold") == HELD_OUT), lambda x: forest.quantiles(x, Q.LEVELS))
    return _losses(held, "q", "forest").drop("estimator")


@query("x15_magnitude_benchmark")
def x15(spark, d):
    """Both estimators on the same held-out rows: loss, crossings of raw quantiles, floored ones, those moved to make
    them rise, and how far the two safeguarded medians lie apart."""
    rows = _sizes(spark, d)
    plain = _stored(rows, "size", rows.where(c("fold") != HELD_OUT))
    boosted = H.boosted_quantiles(plain, len(FEATURES), Q.LEVELS, excluded=[HELD_OUT])
    filled, forest = _forest(rows)
    predictions = {
        "boosted": H.predicted(plain.where(c("fold") == HELD_OUT), boosted.raw),
        "forest": H.predicted(filled.where(c("fold") == HELD_OUT), lambda x: forest.quantiles(x, Q.LEVELS)),
    }
    floor, k = float(np.log(TOLERANCE)), len(Q.LEVELS)
    out = None
    for name, held in predictions.items():
        q = [F.get("q", F.lit(i)) for i in range(k)]
        safe = Q.monotone(c("q"), TOLERANCE)
        crossed = sum(((q[i] < q[i - 1]).cast("int") for i in range(1, k)), F.lit(0))
        floored = sum(((x < floor).cast("int") for x in q), F.lit(0))
        moved = sum(((F.get("safe", F.lit(i)) != F.greatest(q[i], F.lit(floor))).cast("int") for i in range(k)), F.lit(0))
        loss = sum((V.pinball(c("y"), F.get("safe", F.lit(i)), p) for i, p in enumerate(Q.LEVELS)), F.lit(0.0)) / k
        one = held.withColumn("safe", safe).agg(
            F.count("*").alias("n"), F.round(F.sum(c("w") * loss) / F.sum("w"), 5).alias("loss"), F.sum(crossed).alias("crossings"), F.count_if(crossed > 0).alias("crossed_rows"),
            F.sum(floored).alias("floored"), F.sum(moved).alias("moved"), F.round(F.sum(c("w") * F.get("safe", F.lit(k // 2))) / F.sum("w"), 4).alias("mean_median"),
        ).select(F.lit(name).alias("estimator"), "*")
        out = one if out is None else out.unionAll(one)
    return out


_BAND = "CAST(floor((weight - 1) / 13) AS INTEGER)"
_STRATA_SQL = f"SELECT *, CAST((row_number() OVER (PARTITION BY y, band ORDER BY u, case_id) - 1) % 5 AS INTEGER) AS fold FROM (SELECT case_id, weight, CASE WHEN err > 0 THEN 1 ELSE 0 END AS y, {_BAND} AS band, {_hash_sql(chr(39) + 'fold' + chr(39), 'case_id')} AS u FROM cases)"


STRATA = ["y", "band"]


def _labelled(spark, d, *more: str) -> DataFrame:
    """Cases with their label, weight band and the hash that deals them, stored."""
    rows = cases(spark, d).withColumn("y", (c("err") > 0).cast("int")).withColumn("band", F.floor((c("weight") - 1) / 13).cast("int"))
    return V.hashed(rows.select("case_id", "weight", *STRATA, *more), "case_id")


@query("ml02c_stratified_folds", with_tables(f"dealt AS ({_STRATA_SQL})", "SELECT fold, y, band, count(*) AS n, round(sum(weight), 6) AS weight FROM dealt GROUP BY ALL"))
def ml02c(spark, d):
    """Folds dealt within strata of label and weight: counts differ by one at most."""
    return V.dealt(_labelled(spark, d), STRATA, "case_id", FOLDS).groupBy("fold", "y", "band").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


@query("ml02b_nested_calibration")
def ml02b(spark, d):
    """Out-of-fold probabilities: boosted scores of models that left out the fold, calibrated by inner scores alone."""
    rows = _labelled(spark, d, *FEATURES)
    cuts = H.cut_points(rows, FEATURES)
    # Dealt, binned and laid out in one step: ranges of hashes are spread over the tasks, and rows stay where they are.
    narrow = H.plain(rows, FEATURES, target="y", weight="weight", key="case_id", more=[c("y").alias("label"), "band", "case_id", "_u"])
    ordered, deal = V.in_turn(narrow, ["label", "band"], "case_id", FOLDS)
    to_bins = H.binning(cuts)
    scored, _, _, _ = V.nested_scores(ordered, len(FEATURES), FOLDS, read=lambda stream: to_bins(deal(stream)), widths=[len(k) + 2 for k in cuts])
    # Rows of a fold and score count alike from here on: they are scored once and summed.
    w, hit = c("w"), c("hit")
    sums = store(scored.groupBy("fold", "raw", "p").agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.sum(w * c("y")).alias("hit")), "scores")
    mean = lambda x: F.sum(x) / F.sum("w")
    gap = lambda p: hit * (1 - c(p)) * (1 - c(p)) + (w - hit) * c(p) * c(p)
    table = sums.groupBy("fold").agg(
        F.sum("n").alias("n"), mean(hit).alias("observed"), mean(w * c("raw")).alias("raw"), mean(w * c("p")).alias("calibrated"),
        mean(gap("raw")).alias("raw_brier"), mean(gap("p")).alias("brier"),
    )
    share = F.when(w > 0, hit / w).otherwise(0.0)
    auc = ranking_metrics(sums.withColumn("y", share), ["fold"], "raw", "y", "w").select("fold", "auc")
    return table.join(auc, "fold").select("fold", "n", *[F.round(x, 4).alias(x) for x in ("observed", "raw", "calibrated", "raw_brier", "brier", "auc")])


def _classifier(spark, d) -> tuple[DataFrame, H.Forest]:
    rows = _kept(cases(spark, d).withColumn("y", (c("err") > 0).cast("int")).withColumn("fold", _fold()), "y")
    stored = _stored(rows, "y", rows.where(c("fold") != HELD_OUT))
    return stored, H.boosted_probabilities(stored, len(FEATURES), excluded=[(HELD_OUT,)], rounds=20)


@query("ml01b_missing_routed_classifier")
def ml01b(spark, d):
    """A boosted classifier that sends missing values to the side they belong to; ranking of held-out rows, by whether agency2 is known."""
    stored, forest = _classifier(spark, d)
    known = F.get("x", F.lit(FEATURES.index("agency2"))) > 0
    scored = [H.predicted(stored.where((c("fold") == HELD_OUT) & on), lambda x: 1 / (1 + np.exp(-forest.raw(x))), "s").select(F.lit(name).alias("agency2"), F.get("s", F.lit(0)).alias("p"), "y", "w") for name, on in (("known", known), ("missing", ~known))]
    both = scored[0].unionAll(scored[1])
    counts = both.groupBy("agency2").agg(F.count("*").alias("n"), F.round(R.weighted_mean("p", "w"), 4).alias("predicted"), F.round(R.weighted_mean("y", "w"), 4).alias("observed"))
    ranks = ranking_metrics(both, ["agency2"], "p", "y", "w")
    return counts.join(ranks, "agency2").select("agency2", "n", "predicted", "observed", F.round("auc", 4).alias("auc"), F.round("average_precision", 4).alias("average_precision"))


@query("ml08b_fitted_importance")
def ml08b(spark, d):
    """Weighted permutation importance of the fitted classifier on held-out rows, three repeats."""
    stored, forest = _classifier(spark, d)
    out = V.permutation_importance(stored.where(c("fold") == HELD_OUT), FEATURES, lambda x: 1 / (1 + np.exp(-forest.raw_of(x, 0))))
    return out.select("feature", F.round("auc_loss", 4).alias("auc_loss"), F.round("sd", 5).alias("sd"), "repeats")
