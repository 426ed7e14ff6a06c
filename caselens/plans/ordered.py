"""Window, ordered and quantile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quantiles as Q
from ..operators import windows as X
from ..sources.cases import cases
from .registry import panel, query, with_tables

c = F.col

_BUDGET = """budget AS (SELECT *, coalesce(sum(weight) OVER (PARTITION BY grp ORDER BY score DESC, case_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(weight) OVER (PARTITION BY grp) AS total FROM cases),
member AS (SELECT *, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), (total * CAST(0.1 AS DOUBLE) - before) / weight)) AS membership FROM budget)"""


def _members(spark, d, *more: str):
    return X.budget_membership(cases(spark, d).select("case_id", "grp", "score", "weight", *more), ["grp"], "score", ["case_id"], "weight", 0.1)


@query("win01_budget_membership", with_tables(_BUDGET, "SELECT case_id, round(membership, 8) AS membership FROM member WHERE membership > 0"))
def win01(spark, d):
    return _members(spark, d).where("membership > 0").select("case_id", F.round("membership", 8).alias("membership"))


@query("win01b_ranged_running_sum", "SELECT case_id, before FROM (SELECT case_id, coalesce(sum(weight) OVER (ORDER BY score, case_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM cases)")
def win01b(spark, d):
    rows = cases(spark, d).withColumn("_all", F.lit(0))
    out = X.running_before(rows, ["_all"], [F.asc("score"), F.asc("case_id")], "weight", "before", coarse=F.floor(c("score") * 100 + 0.5))
    return out.select("case_id", "before")


@query("win02_dollar_capture", with_tables(_BUDGET, "SELECT grp, round(sum(membership * weight * err) / sum(weight * err), 8) AS capture FROM member GROUP BY grp"))
def win02(spark, d):
    w = c("weight") * c("err")
    return _members(spark, d, "err").groupBy("grp").agg(F.round(F.sum(c("membership") * w) / F.sum(w), 8).alias("capture"))


_QUANTILES = """wq AS (SELECT grp, amount, sum(weight) AS w FROM cases GROUP BY grp, amount),
wq2 AS (SELECT *, sum(w) OVER (PARTITION BY grp ORDER BY amount ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY grp) AS total FROM wq),
quant AS (SELECT grp, p AS level, min(amount) AS value FROM wq2, (VALUES (CAST(0.5 AS DOUBLE)), (CAST(0.9 AS DOUBLE))) t(p) WHERE upto >= p * total GROUP BY grp, p)"""


@query("win03_weighted_quantiles", with_tables(_QUANTILES, "SELECT grp, level, round(value, 8) AS value FROM quant"))
def win03(spark, d):
    return X.weighted_quantiles(cases(spark, d), ["grp"], "amount", "weight", [0.5, 0.9]).select("grp", "level", F.round("value", 8).alias("value"))


_LABELLED = "labelled AS (SELECT *, CASE WHEN err > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS y FROM cases)"


def _labelled(spark, d):
    return cases(spark, d).withColumn("y", (c("err") > 0).cast("double"))


@query(
    "win04_precision_at",
    with_tables(
        _LABELLED + ", r AS (SELECT *, coalesce(sum(weight) OVER (PARTITION BY grp ORDER BY score DESC, case_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(weight) OVER (PARTITION BY grp) AS total, sum(weight * y) OVER (PARTITION BY grp) AS pos FROM labelled)",
        "SELECT grp, round(sum(weight * y) / sum(weight), 8) AS precision, round(sum(weight * y) / max(pos), 8) AS recall FROM r WHERE before < 0.05 * total GROUP BY grp",
    ),
)
def win04(spark, d):
    p = X.precision_at(_labelled(spark, d).select("case_id", "grp", "score", "weight", "y"), ["grp"], "score", ["case_id"], "y", "weight", 0.05)
    return p.select("grp", F.round("precision", 8).alias("precision"), F.round("recall", 8).alias("recall"))


@query(
    "win05_auc_ap",
    with_tables(
        _LABELLED + ", st AS (SELECT region, score, sum(weight * y) AS pos, sum(weight * (1 - y)) AS neg FROM labelled GROUP BY region, score), st2 AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY region) AS pa, sum(neg) OVER (PARTITION BY region) AS na FROM st WINDOW w AS (PARTITION BY region ORDER BY score DESC ROWS UNBOUNDED PRECEDING))",
        "SELECT region, round(sum(neg * (tp - pos / 2)) / max(pa * na), 8) AS auc, round(sum(pos / pa * tp / (tp + fp)), 8) AS average_precision FROM st2 GROUP BY region",
    ),
)
def win05(spark, d):
    m = X.ranking_metrics(_labelled(spark, d), ["region"], "score", "y", "weight")
    return m.select("region", F.round("auc", 8).alias("auc"), F.round("average_precision", 8).alias("average_precision"))


@query("win06_mean_excess", with_tables(_QUANTILES, "SELECT grp, level, round(sum(weight * (amount - value)) / sum(weight), 6) AS excess, round(sum(weight) * sum(weight) / sum(weight * weight), 6) AS n_eff FROM cases JOIN quant USING (grp) WHERE amount > value GROUP BY grp, level"))
def win06(spark, d):
    m = X.mean_excess(cases(spark, d), ["grp"], "amount", "weight", [0.5, 0.9])
    return m.select("grp", "level", F.round("excess", 6).alias("excess"), F.round("n_eff", 6).alias("n_eff"))


_SPREADS = "(1 + i * CAST(0.05 AS DOUBLE))"


@query(
    "win07_grid_search",
    with_tables(
        "pos AS (SELECT region, amount, sum(weight) AS w FROM cases WHERE amount > 0 GROUP BY region, amount), cum AS (SELECT *, sum(w) OVER (PARTITION BY region ORDER BY amount ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY region) AS f FROM pos), "
        f"grid AS (SELECT region, CAST(i AS INTEGER) AS i, abs(coalesce(max(f) FILTER (WHERE amount <= 1000 * {_SPREADS}), 0) - 0.5) AS gap FROM cum, range(0, 41) t(i) GROUP BY region, i)",
        "SELECT region, i AS best, round(gap, 8) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY round(gap, 10), i) AS rn FROM grid) WHERE rn = 1",
    ),
)
def win07(spark, d):
    # Each row falls in the first grid cell that covers it, so coverage per cell is a running sum over cells, not rows times cells.
    cell = F.greatest(F.lit(0), F.ceil((c("amount") / 1000 - 1) / 0.05 - 1e-12)).cast("int")
    rows = cases(spark, d).where("amount > 0").withColumn("i", cell)
    sums = rows.groupBy("region", "i").agg(F.sum("weight").alias("w"))
    grid = rows.select("region").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(40))))
    total = rows.groupBy("region").agg(F.sum("weight").alias("total"))
    filled = grid.join(sums, ["region", "i"], "left").join(total, "region").withColumn("w", F.coalesce("w", F.lit(0.0)))
    from pyspark.sql import Window as W

    upto = F.sum("w").over(W.partitionBy("region").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    gap = filled.withColumn("gap", F.abs(upto / c("total") - 0.5))
    best = gap.groupBy("region").agg(F.min(F.struct(F.round("gap", 10).alias("r"), c("i"), c("gap"))).alias("m"))
    return best.select("region", c("m.i").alias("best"), F.round("m.gap", 8).alias("gap"))


@query("win08_running_max", "SELECT grp, period, max(rate) OVER (PARTITION BY grp ORDER BY period ROWS UNBOUNDED PRECEDING) AS highest FROM panel")
def win08(spark, d):
    return X.cumulative_max(panel(spark, d), ["grp"], "period", "rate", "highest").select("grp", "period", "highest")


@query("win09_placebo_rank", "SELECT a.grp, a.period, CAST(1 + count(*) FILTER (WHERE b.grp <> a.grp AND abs(b.rate - 10) >= abs(a.rate - 10)) AS BIGINT) AS rank FROM panel a JOIN panel b USING (period) GROUP BY a.grp, a.period")
def win09(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("period").orderBy(F.abs(c("rate") - 10).desc()).rangeBetween(W.unboundedPreceding, W.currentRow)
    return panel(spark, d).select("grp", "period", F.count("*").over(w).alias("rank"))


@query("win10_midrank", "SELECT a.grp, round((count(*) FILTER (WHERE b.rate < a.rate) + count(*) FILTER (WHERE b.rate <= a.rate)) / (2.0 * count(*)), 8) AS pit FROM panel a JOIN panel b USING (grp) WHERE a.period = 2000 GROUP BY a.grp")
def win10(spark, d):
    p = panel(spark, d)
    real = p.where("period = 2000").select("grp", c("rate").alias("value"))
    return X.midrank(p, real, ["grp"], "rate", "value").select("grp", F.round("pit", 8).alias("pit"))


@query("win11_changes", "SELECT grp, period, before, n FROM (SELECT grp, period, n, lag(n) OVER (PARTITION BY grp ORDER BY period) AS before FROM panel) WHERE before IS NOT NULL AND before <> n")
def win11(spark, d):
    return X.changes(panel(spark, d), ["grp"], "period", "n").select("grp", "period", "before", "n")


@query("win13_positional_id", "SELECT case_id, row_number() OVER (PARTITION BY grp ORDER BY case_id) AS pos FROM cases")
def win13(spark, d):
    return X.places(cases(spark, d).select("grp", "case_id"), ["grp"], [F.asc("case_id")], "pos").select("case_id", "pos")


@query("win14_priced_shifts", "SELECT shift, bound, round(count(*) FILTER (WHERE rate + shift >= bound) / CAST(count(*) AS DOUBLE), 8) AS share FROM panel, (VALUES (CAST(-2 AS DOUBLE)), (CAST(0 AS DOUBLE)), (CAST(2 AS DOUBLE))) s(shift), (VALUES (CAST(6 AS DOUBLE)), (CAST(8 AS DOUBLE)), (CAST(10 AS DOUBLE))) b(bound) GROUP BY shift, bound")
def win14(spark, d):
    return X.priced_shifts(panel(spark, d), [-2.0, 0.0, 2.0], "rate", [6.0, 8.0, 10.0]).select("shift", "bound", F.round("share", 8).alias("share"))


# Quantile algebra: each case has nine log quantiles, a fixed ladder moved by its size.
_STEPS = (3.0, 3.4, 4.1, 5.0, 5.8, 6.6, 7.1, 7.6, 8.2)
_LADDER = "[" + ", ".join(f"CAST({s} AS DOUBLE) + ln(1 + line)" for s in _STEPS) + "]"
_Q = f"q AS (SELECT case_id, grp, weight, amount, base, score, line, {_LADDER} AS q FROM cases)"


def ladder():
    return [F.lit(s) + F.ln(1 + c("line")) for s in _STEPS]


def _quantiles(spark, d):
    return cases(spark, d).withColumn("q", F.array(*ladder()))


@query("qnt01_monotone", with_tables(_Q, "SELECT case_id, round(list_sort(list_transform([q[3], q[1], q[2]], lambda v: greatest(v, ln(CAST(30 AS DOUBLE)))))[1], 8) AS low, round(list_sort(list_transform([q[3], q[1], q[2]], lambda v: greatest(v, ln(CAST(30 AS DOUBLE)))))[3], 8) AS high FROM q"))
def qnt01(spark, d):
    m = Q.monotone(F.array(F.get("q", F.lit(2)), F.get("q", F.lit(0)), F.get("q", F.lit(1))), 30.0)
    return _quantiles(spark, d).select("case_id", F.round(F.get(m, F.lit(0)), 8).alias("low"), F.round(F.get(m, F.lit(2)), 8).alias("high"))


def _survival_sql(x: str) -> str:
    levels = Q.LEVELS
    out = f"CASE WHEN {x} >= q[9] THEN {1 - levels[-1]:.17g} * exp(-({x} - q[9]) / CAST(0.4 AS DOUBLE)) "
    for i in range(8):
        out += f"WHEN {x} >= q[{i + 1}] AND {x} < q[{i + 2}] THEN 1 - (CAST({levels[i]} AS DOUBLE) + ({x} - q[{i + 1}]) / (q[{i + 2}] - q[{i + 1}]) * (CAST({levels[i + 1]} AS DOUBLE) - CAST({levels[i]} AS DOUBLE))) "
    return out + "ELSE 1 END"


@query("qnt02_survival", with_tables(_Q, f"SELECT case_id, round({_survival_sql('ln(CAST(500 AS DOUBLE))')}, 8) AS p FROM q"))
def qnt02(spark, d):
    return _quantiles(spark, d).select("case_id", F.round(Q.survival(F.lit(500.0), c("q"), F.lit(0.4)), 8).alias("p"))


def _inverse_sql(u: str) -> str:
    levels = Q.LEVELS
    out = f"CASE WHEN {u} < CAST({levels[0]} AS DOUBLE) THEN q[1] "
    for i in range(8):
        out += f"WHEN {u} < CAST({levels[i + 1]} AS DOUBLE) THEN q[{i + 1}] + ({u} - CAST({levels[i]} AS DOUBLE)) / (CAST({levels[i + 1]} AS DOUBLE) - CAST({levels[i]} AS DOUBLE)) * (q[{i + 2}] - q[{i + 1}]) "
    return out + f"ELSE q[9] + CAST(0.4 AS DOUBLE) * ln({1 - levels[-1]:.17g} / (1 - least({u}, 1 - CAST(1e-12 AS DOUBLE)))) END"


@query("qnt03_inverse", with_tables(_Q, f"SELECT case_id, round({_inverse_sql('score * 12.4')}, 8) AS x FROM q"))
def qnt03(spark, d):
    return _quantiles(spark, d).select("case_id", F.round(Q.inverse(c("score") * 12.4, c("q"), F.lit(0.4)), 8).alias("x"))


@query("qnt05_strict_error", "SELECT case_id, round(CASE WHEN abs(deviation) > 56 THEN abs(deviation) ELSE 0 END, 8) AS err FROM cases")
def qnt05(spark, d):
    return cases(spark, d).select("case_id", F.round(F.when(F.abs("deviation") > 56, F.abs("deviation")).otherwise(0.0), 8).alias("err"))


def _expected_sql() -> str:
    lo, hi, top = "ln(CAST(500 AS DOUBLE))", "ln(base * 0.5)", len(Q.LEVELS)
    between = [f"CASE WHEN least(q[{i + 2}], {hi}) > greatest(q[{i + 1}], {lo}) THEN {Q.LEVELS[i + 1] - Q.LEVELS[i]:.17g} * (exp(least(q[{i + 2}], {hi})) - exp(greatest(q[{i + 1}], {lo}))) / (q[{i + 2}] - q[{i + 1}]) ELSE 0 END" for i in range(top - 1)]
    first = f"CASE WHEN q[1] > {lo} AND q[1] <= {hi} THEN {Q.LEVELS[0]} * exp(q[1]) ELSE 0 END"
    s, t = f"greatest(q[{top}], {lo})", f"greatest(q[{top}], {hi})"
    tail = f"CASE WHEN {t} > {s} THEN {1 - Q.LEVELS[-1]:.17g} / CAST(0.4 AS DOUBLE) * exp(q[{top}] / CAST(0.4 AS DOUBLE)) * (exp(CAST(-1.5 AS DOUBLE) * {t}) - exp(CAST(-1.5 AS DOUBLE) * {s})) / CAST(-1.5 AS DOUBLE) ELSE 0 END"
    return f"CASE WHEN base * 0.5 <= 500 THEN 0 ELSE {' + '.join([first, *between, tail])} + base * 0.5 * ({_survival_sql(hi)}) END"


@query("qnt06_expected_error", with_tables(_Q, f"SELECT case_id, round({_expected_sql()}, 6) AS expected FROM q"))
def qnt06(spark, d):
    e = Q.expected_above(F.lit(500.0), c("q"), F.lit(0.4), c("base") * 0.5)
    return _quantiles(spark, d).select("case_id", F.round(e, 6).alias("expected"))


@query("qnt07_coverage", with_tables(_Q, "SELECT level, round(sum(CASE WHEN amount > 0 AND ln(amount) <= q[k] THEN weight WHEN amount <= 0 THEN weight ELSE 0 END) / sum(weight), 8) AS covered FROM q, (VALUES " + ", ".join(f"({i + 1}, CAST({p} AS DOUBLE))" for i, p in enumerate(Q.LEVELS)) + ") t(k, level) GROUP BY level"))
def qnt07(spark, d):
    w = c("weight")
    hit = [F.sum(F.when((c("amount") <= 0) | (F.ln("amount") <= F.get("q", F.lit(i))), w).otherwise(0.0)) / F.sum(w) for i in range(9)]
    rows = F.array(*[F.struct(F.lit(p).alias("level"), F.round(F.col(f"h{i}"), 8).alias("covered")) for i, p in enumerate(Q.LEVELS)])
    return _quantiles(spark, d).agg(*[h.alias(f"h{i}") for i, h in enumerate(hit)]).select(F.inline(rows))


@query("qnt08_at_levels", with_tables(_Q, "SELECT case_id, round(q[4] + (CAST(0.6 AS DOUBLE) - CAST(0.5 AS DOUBLE)) / CAST(0.25 AS DOUBLE) * (q[5] - q[4]), 8) AS q60, round(q[1], 8) AS q01, round(q[9], 8) AS q999 FROM q"))
def qnt08(spark, d):
    at = Q.at_levels(c("q"), [0.6, 0.01, 0.999])
    return _quantiles(spark, d).select("case_id", *[F.round(F.get(at, F.lit(i)), 8).alias(n) for i, n in enumerate(("q60", "q01", "q999"))])


@query("qnt09_spread", with_tables(_Q, "SELECT case_id, round(q[5] + CAST(1.2 AS DOUBLE) * (q[1] - q[5]), 8) AS low, round(q[5] + CAST(1.2 AS DOUBLE) * (q[9] - q[5]), 8) AS high FROM q"))
def qnt09(spark, d):
    s = Q.spread_about_median(c("q"), F.lit(1.2))
    return _quantiles(spark, d).select("case_id", F.round(F.get(s, F.lit(0)), 8).alias("low"), F.round(F.get(s, F.lit(8)), 8).alias("high"))


@query("qnt10_capped_crossing", with_tables(_Q, f"SELECT case_id, round(CASE WHEN base * 0.02 <= 500 THEN 0 ELSE {_survival_sql('ln(CAST(500 AS DOUBLE))')} END, 8) AS p FROM q"))
def qnt10(spark, d):
    p = F.when(c("base") * 0.02 <= 500, 0.0).otherwise(Q.survival(F.lit(500.0), c("q"), F.lit(0.4)))
    return _quantiles(spark, d).select("case_id", F.round(p, 8).alias("p"))
