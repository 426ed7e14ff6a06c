"""Persistence of rates: fits in every replicate, fitted conditional paths, exposure over coming years."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import panel as P
from ..operators import persistence as M
from ..sources.cases import cases
from .projections import TIER_SQL
from .registry import query, with_tables
from .simulation import _RNG

c = F.col
YEARS = list(range(1995, 2002))
LAST, HORIZON = 2000, [2001, 2002, 2003, 2004]
GRID, REPLICATES, DRAWS, SEED = 19, 30, 50, 23

_CELLS = f"""cell0 AS (SELECT grp, grp_no, period, sum(weight * err) AS we, sum(weight * base) AS wb, sum(weight * weight * err * err) AS ee, sum(weight * weight * err * base) AS eb, sum(weight * weight * base * base) AS bb
  FROM cases WHERE period BETWEEN {YEARS[0]} AND {YEARS[-1]} GROUP BY grp, grp_no, period HAVING sum(weight * base) > 0),
cell AS (SELECT * FROM (SELECT grp, grp_no, period, round(100 * (we / wb), 10) AS rate, round(10000 * (ee - 2 * (we / wb) * eb + (we / wb) * (we / wb) * bb) / (wb * wb), 10) AS v, count(*) OVER (PARTITION BY grp) AS n FROM cell0) WHERE n = {len(YEARS)})"""


def _fit_sql(src: str, unit: str, by: str) -> str:
    """The components of rows of ``src`` for every ``by``: moments, then least squares over the grid."""
    one = "CAST(1 AS DOUBLE)"
    return f"""dm AS (SELECT *, rate - avg(rate) OVER (PARTITION BY {by}, period) AS x, count(*) OVER (PARTITION BY {by}, period) AS units FROM {src}),
noise AS (SELECT {by}, avg(v) AS noise FROM {src} GROUP BY {by}),
prod AS (SELECT a.{by}, b.period - a.period AS lag, CAST(count(*) AS DOUBLE) AS n, avg(a.x * b.x * a.units / (a.units - 1)) AS product FROM dm a JOIN dm b ON a.{by} = b.{by} AND a.{unit} = b.{unit} AND b.period - a.period BETWEEN 0 AND 3 GROUP BY ALL),
pts AS (SELECT prod.{by}, i / CAST({GRID + 1} AS DOUBLE) AS rho, n, CASE WHEN lag = 0 THEN product - noise ELSE product END AS y, pow(i / CAST({GRID + 1} AS DOUBLE), lag) AS x FROM prod JOIN noise ON prod.{by} = noise.{by}, range(1, {GRID + 1}) t(i)),
sm AS (SELECT {by}, rho, sum(n) AS w, sum(n * x) AS wx, sum(n * y) AS wy, sum(n * x * x) AS wxx, sum(n * x * y) AS wxy, sum(n * y * y) AS wyy FROM pts GROUP BY {by}, rho),
ab AS (SELECT *, (w * wxy - wx * wy) / (w * wxx - wx * wx) AS b FROM sm), ab2 AS (SELECT *, (wy - b * wx) / w AS a FROM ab),
cl AS (SELECT *, CASE WHEN a >= 0 AND b >= 0 THEN a WHEN a < 0 THEN 0 * {one} ELSE greatest(0 * {one}, wy / w) END AS fixed, CASE WHEN a >= 0 AND b >= 0 THEN b WHEN a < 0 THEN greatest(0 * {one}, wxy / wxx) ELSE 0 * {one} END AS drifting FROM ab2),
er AS (SELECT *, round(wyy - 2 * fixed * wy - 2 * drifting * wxy + fixed * fixed * w + 2 * fixed * drifting * wx + drifting * drifting * wxx, 9) AS sse FROM cl),
fit AS (SELECT {by}, rho, fixed, drifting FROM er QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY sse, rho) = 1)"""


_PICKS = f"""unit AS (SELECT grp, row_number() OVER (ORDER BY grp) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT grp FROM cell)),
idx AS (SELECT CAST(d AS INTEGER) AS replicate, CAST(j AS INTEGER) AS slot, n, CAST({SEED} AS BIGINT) AS seed, CAST(d * n + j AS BIGINT) AS k FROM (SELECT DISTINCT n FROM unit), range(0, {REPLICATES}) t(d), LATERAL (SELECT unnest(range(1, n + 1)) AS j)),{_RNG},
boot AS (SELECT replicate, slot, period, rate, v FROM uni JOIN unit ON unit.i = CAST(floor(u * uni.n) AS BIGINT) JOIN cell USING (grp))"""


@query("bst05b_refit_components", with_tables(f"{_CELLS}, {_PICKS}, {_fit_sql('boot', 'slot', 'replicate')}", "SELECT replicate, rho, round(fixed, 5) AS fixed, round(drifting, 5) AS drifting FROM fit"))
def bst05b(spark, d):
    """The whole fit (demeaning, lag products, grid of correlations) in every replicate of the jurisdictions."""
    boot = M.resampled(M.cells(cases(spark, d), YEARS), REPLICATES, SEED)
    fit = P.components_by(M.moments(boot, ["replicate"], "slot"), ["replicate"], GRID)
    return fit.select("replicate", "rho", F.round("fixed", 5).alias("fixed"), F.round("drifting", 5).alias("drifting"))


def _factor_sql(src: str, n: int, entry, name: str) -> tuple[list[str], str]:
    """Steps that add the columns of a lower factor, column by column."""
    steps = []
    for j in range(n):
        less = lambda i, j=j: "".join(f" - {name}{i}_{k} * {name}{j}_{k}" for k in range(j))
        steps.append(f"{name}d{j} AS (SELECT *, sqrt({entry(j, j)}{less(j)}) AS {name}{j}_{j} FROM {src})")
        rest = "".join(f", ({entry(i, j)}{less(i)}) / {name}{j}_{j} AS {name}{i}_{j}" for i in range(j + 1, n))
        steps.append(f"{name}c{j} AS (SELECT *{rest} FROM {name}d{j})")
        src = f"{name}c{j}"
    return steps, src


def _law_sql(horizon: list[int]) -> tuple[str, str]:
    """Common tables up to one with mean0.. and the factor m0_0.. of every jurisdiction."""
    past, n = [t for t in YEARS if t <= LAST], LAST - YEARS[0] + 1
    wide = "wide AS (SELECT grp, " + ", ".join(f"max(x) FILTER (WHERE period = {t}) AS x{i}, max(v) FILTER (WHERE period = {t}) AS v{i}" for i, t in enumerate(past)) + f" FROM (SELECT *, rate - avg(rate) OVER (PARTITION BY period) AS x FROM cell WHERE period <= {LAST}) GROUP BY grp), start AS (SELECT * FROM wide, fit)"
    law = lambda a, b: f"(fixed + drifting * pow(rho, {abs(a - b)}))"
    steps, src = _factor_sql("start", n, lambda i, j: law(i, j) + (f" + v{i}" if i == j else ""), "l")
    for i in range(n):
        solve = lambda right, y, i=i: f"({right}" + "".join(f" - l{i}_{k} * {y}_{k}" for k in range(i)) + f") / l{i}_{i} AS {y}_{i}"
        steps.append(f"y{i} AS (SELECT *, {solve(f'x{i}', 'z')}, " + ", ".join(solve(law(h, past[i]), f"c{j}") for j, h in enumerate(horizon)) + f" FROM {src})")
        src = f"y{i}"
    inner = lambda a, b: " + ".join(f"{a}_{k} * {b}_{k}" for k in range(n))
    steps.append("means AS (SELECT *, " + ", ".join(f"{inner(f'c{j}', 'z')} AS mean{j}" for j in range(len(horizon))) + f" FROM {src})")
    left, src = _factor_sql("means", len(horizon), lambda i, j: f"{law(horizon[i], horizon[j])} - ({inner(f'c{i}', f'c{j}')})" + (" + CAST(1e-9 AS DOUBLE)" if i == j else ""), "m")
    return ", ".join([wide, *steps, *left]), src


def _fitted(spark, d):
    rows = M.cells(cases(spark, d), YEARS)
    past = rows.where(c("period") <= LAST)
    fit = P.components_by(M.moments(past.withColumn("one", F.lit(1)), ["one"], "grp"), ["one"], GRID)
    return rows, fit


_PAST = f"{_CELLS}, past AS (SELECT *, 1 AS one FROM cell WHERE period <= {LAST}), {_fit_sql('past', 'grp', 'one')}"
_LAW1, _SRC1 = _law_sql(HORIZON[:1])
_LAW4, _SRC4 = _law_sql(HORIZON)
_SCORE = "count(*) AS n, round(avg(abs(p - y)), 6) AS mae, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, round(CASE WHEN stddev_pop(p) > 0 THEN covar_pop(p, y) / (stddev_pop(p) * stddev_pop(y)) ELSE 0 END, 6) AS corr"


@query(
    "opt06b_fitted_path",
    with_tables(
        f"{_PAST}, {_LAW1}, goal AS (SELECT grp, rate - avg(rate) OVER () AS y FROM cell WHERE period = {HORIZON[0]})",
        f"SELECT method, {_SCORE} FROM (SELECT grp, unnest(['conditional', 'last value', 'mean']) AS method, unnest([mean0, x{LAST - YEARS[0]}, CAST(0 AS DOUBLE)]) AS p FROM {_SRC1}) JOIN goal USING (grp) GROUP BY method",
    ),
)
def opt06b(spark, d):
    """Next year's demeaned rates predicted from the fitted components, scored beside the last value and the mean."""
    rows, fit = _fitted(spark, d)
    law = M.conditional_law(M.histories(rows, LAST), fit, HORIZON[:1])
    goal = rows.where(c("period") == HORIZON[0]).select("grp", (c("rate") - F.avg("rate").over(M.W.partitionBy("period"))).alias("y"))
    table = M.scores(law, goal, {"conditional": F.get("mean", F.lit(0)), "last value": F.element_at("x", -1), "mean": F.lit(0.0)})
    return table.select("method", "n", *[F.round(x, 6).alias(x) for x in ("mae", "rmse", "corr")])


_PER = 2 * len(HORIZON) - 1
_Z = ", ".join(f"sqrt(-2 * ln(greatest(max(u) FILTER (WHERE t = {2 * i}), CAST(1e-12 AS DOUBLE)))) * cos(2 * CAST(3.141592653589793 AS DOUBLE) * max(u) FILTER (WHERE t = {2 * i + 1})) AS z{i}" for i in range(_PER))
_PATHS = " UNION ALL ".join(
    f"SELECT grp, draw, {HORIZON[h]} AS year, anchor + mean{h} - mean0 + " + " + ".join(f"m{h}_{k} * z{k}" for k in range(h + 1)) + f" + z{len(HORIZON) + h - 1} * sqrt(v{LAST - YEARS[0]}) AS unclipped FROM {_SRC4} JOIN zs USING (grp) JOIN anchors USING (grp)"
    for h in range(1, len(HORIZON))
)


@query(
    "bst10b_fitted_exposure",
    with_tables(
        f"{_PAST}, {_LAW4}, anchors AS (SELECT grp, 1000 + grp_no AS seed, rate AS anchor FROM cell WHERE period = {HORIZON[0]}), "
        f"idx AS (SELECT grp, d AS draw, CAST(seed AS BIGINT) AS seed, CAST(d * {2 * _PER} + t + 1 AS BIGINT) AS k, t FROM anchors, range(0, {DRAWS}) x(d), range(0, {2 * _PER}) y(t)),{_RNG}, zs AS (SELECT grp, draw, {_Z} FROM uni GROUP BY grp, draw), "
        f"paths AS ({_PATHS}), tiers AS (SELECT *, greatest(unclipped, 0) AS r, {TIER_SQL.format('greatest(unclipped, 0)')} AS share FROM paths)",
        "SELECT grp, CAST(year AS INTEGER) AS year, round(avg(r), 6) AS mean_rate, round(stddev_pop(r), 6) AS sd_rate, round(avg(share), 6) AS expected_share, round(avg(CASE WHEN unclipped < 0 THEN 1.0 ELSE 0.0 END), 6) AS p_clipped FROM tiers GROUP BY grp, year",
    ),
)
def bst10b(spark, d):
    """Three coming years' rates and cost shares of every jurisdiction: draws from the fitted conditional law with sampling noise."""
    rows, fit = _fitted(spark, d)
    law = M.conditional_law(M.histories(rows, LAST), fit, HORIZON)
    anchors = rows.where(c("period") == HORIZON[0]).select("grp", (1000 + c("grp_no")).cast("long").alias("seed"), c("rate").alias("anchor"))
    out = M.exposure(law, anchors, HORIZON, DRAWS).groupBy("grp", "year").agg(F.avg("rate").alias("m"), F.stddev_pop("rate").alias("s"), F.avg("share").alias("e"), F.avg((c("unclipped") < 0).cast("double")).alias("p"))
    return out.select("grp", "year", F.round("m", 6).alias("mean_rate"), F.round("s", 6).alias("sd_rate"), F.round("e", 6).alias("expected_share"), F.round("p", 6).alias("p_clipped"))
