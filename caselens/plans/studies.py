"""Studies: resampling at population size, intervention grids, null distributions, rosters, fixed donors, repairs and verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import quantiles as Q
from ..functions import rng
from ..functions import scalars as S
from ..operators import bootstrap as B
from ..operators import rates as R
from ..operators import windows as X
from ..sources.cases import cases
from ..sources.shared import store
from .ordered import _Q, _quantiles, _survival_sql, ladder
from .projections import TIER_SQL
from .registry import panel, query, with_tables

c = F.col


def _hash_sql(seed: str, key: str) -> str:
    return f"CAST('0x' || substr(sha256({seed} || '|' || {key}), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE)"


def _poisson_sql(u: str) -> str:
    return "CASE " + " ".join(f"WHEN {u} < CAST({p!r} AS DOUBLE) THEN {k}" for k, p in enumerate(B.POISSON)) + f" ELSE {len(B.POISSON)} END"


@query("rng04_group_seed", "SELECT DISTINCT grp, list_reduce(list_prepend(CAST(20260820 AS BIGINT), list_transform(string_split(grp, ''), lambda x: CAST(unicode(x) AS BIGINT))), lambda a, x: xor(a, x) * 16777619 % 4294967296) AS seed FROM cases")
def rng04(spark, d):
    return cases(spark, d).select("grp").distinct().select("grp", rng.text_seed(c("grp")).alias("seed"))


_MULT = f"mult AS (SELECT grp, draw, weight * err * k AS we, weight * base * k AS wb FROM (SELECT *, {_poisson_sql('u')} AS k FROM (SELECT cases.*, CAST(t.i AS INTEGER) AS draw, {_hash_sql('CAST(t.i AS VARCHAR)', 'case_id')} AS u FROM cases, range(0, 10) t(i))))"


@query("bst01c_poisson_bootstrap", with_tables(_MULT, "SELECT grp, draw, round(sum(we) * 100 / sum(wb), 6) AS rate FROM mult GROUP BY grp, draw"))
def bst01c(spark, d):
    t = B.poisson_sums(cases(spark, d), ["grp"], "case_id", 10, we=c("weight") * c("err"), wb=c("weight") * c("base"))
    return t.select("grp", "draw", F.round(c("we") * 100 / c("wb"), 6).alias("rate"))


RULES = {"oracle": "err", "model": "score", "flagged": "flag", "random": "u"}
SETTINGS = [(r, k, e) for r in RULES for k in (0.05, 0.1, 0.2) for e in (0.5, 1.0)]
_RULED = "ruled AS (SELECT *, CASE WHEN line = 3 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS flag, " + _hash_sql("'order'", "case_id") + " AS u, sum(weight) OVER (PARTITION BY grp) AS total FROM cases), " + "befores AS (SELECT *, " + ", ".join(
    f"coalesce(sum(weight) OVER (PARTITION BY grp ORDER BY {col} DESC, case_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b_{rule}" for rule, col in RULES.items()
) + " FROM ruled)"


def _cut_sql(rule: str, k: float, e: float) -> str:
    return f"(1 - CAST({e} AS DOUBLE) * greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), (total * CAST({k} AS DOUBLE) - b_{rule}) / weight)))"


@query(
    "bst11b_rules_by_coverage",
    with_tables(
        _RULED + f", k AS (SELECT b.*, t.i AS draw, {_poisson_sql(_hash_sql('CAST(t.i AS VARCHAR)', 'case_id'))} AS k FROM befores b, range(0, 6) t(i)), s AS (SELECT grp, draw, sum(weight * base * k) AS wb, sum(weight * err * k) AS we, "
        + ", ".join(f"sum(weight * err * k * {_cut_sql(*s)}) AS s{i}" for i, s in enumerate(SETTINGS)) + " FROM k GROUP BY grp, draw), "
        "long AS (SELECT grp, draw, wb, we, unnest([" + ", ".join(f"'{r}'" for r, _, _ in SETTINGS) + "]) AS rule, unnest([" + ", ".join(f"CAST({k} AS DOUBLE)" for _, k, _ in SETTINGS) + "]) AS coverage, unnest([" + ", ".join(f"CAST({e} AS DOUBLE)" for _, _, e in SETTINGS) + "]) AS effect, unnest([" + ", ".join(f"s{i}" for i in range(len(SETTINGS))) + "]) AS s FROM s)",
        "SELECT grp, rule, coverage, effect, round(avg((s - we) * 100 / wb), 6) + 0.0 AS mean_delta, round(stddev_samp(s * 100 / wb), 6) AS sd_rate FROM long GROUP BY grp, rule, coverage, effect",
    ),
)
def bst11b(spark, d):
    """Four rankings by three coverages by two effects, each over the same resampling draws."""
    rows = store(cases(spark, d).select("grp", "case_id", "weight", "base", "err", "score", (c("line") == 3).cast("double").alias("flag"), rng.hash_uniform(F.lit("order"), c("case_id")).alias("u")), "ruled")
    shares = sorted({k for _, k, _ in SETTINGS})
    we = c("weight") * c("err")
    parts = []
    # A ranking at a time over the stored rows: all twelve ends in one expression make a method too long to be compiled.
    for rule, col in RULES.items():
        grid = [(k, e) for r, k, e in SETTINGS if r == rule]
        cuts = X.budget_cuts(rows, ["grp"], {rule: col}, ["case_id"], "weight", shares)
        inside = {f"i{i}": we * X.inside_cut(col, ["case_id"], "weight", rule, k) for i, k in enumerate(shares)}
        sums = B.poisson_sums(rows.join(cuts, "grp"), ["grp"], "case_id", 6, wb=c("weight") * c("base"), we=we, **inside)
        long = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(k).alias("coverage"), F.lit(e).alias("effect"), (c("we") - e * c(f"i{shares.index(k)}")).alias("s")) for k, e in grid])
        parts.append(sums.select("grp", "wb", "we", F.inline(long)))
    each = reduce(DataFrame.unionByName, parts)
    return each.groupBy("grp", "rule", "coverage", "effect").agg((F.round(F.avg((c("s") - c("we")) * 100 / c("wb")), 6) + 0.0).alias("mean_delta"), F.round(F.stddev_samp(c("s") * 100 / c("wb")), 6).alias("sd_rate"))


@query(
    "win07b_fine_grid",
    with_tables(
        "pos AS (SELECT region, round(amount, 4) AS a, sum(weight) AS w FROM cases WHERE amount > 0 GROUP BY 1, 2), cum AS (SELECT region, a, sum(w) OVER (PARTITION BY region ORDER BY a ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY region) AS f FROM pos), "
        "pts AS (SELECT region, CAST(i AS INTEGER) AS i, CAST(1000 + i AS DOUBLE) AS a FROM (SELECT DISTINCT region FROM cum), range(0, 2501) t(i)), grid AS (SELECT p.region, p.i, abs(coalesce(m.f, 0) - 0.5) AS gap FROM pts p ASOF LEFT JOIN cum m ON p.region = m.region AND p.a >= m.a)",
        "SELECT region, i AS best, round(gap, 8) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY round(gap, 10), i) AS rn FROM grid) WHERE rn = 1",
    ),
)
def win07b(spark, d):
    """The whole grid of 2,501 spreads: each row falls in the first cell that covers it, so only cells are accumulated."""
    rows = cases(spark, d).where("amount > 0").withColumn("i", F.greatest(F.lit(0), F.ceil(F.round("amount", 4) - 1000)).cast("int"))
    sums = rows.groupBy("region", "i").agg(F.sum("weight").alias("w"))
    total = sums.groupBy("region").agg(F.sum("w").alias("total"))
    grid = total.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2500)))).join(sums, ["region", "i"], "left")
    upto = F.sum(F.coalesce("w", F.lit(0.0))).over(W.partitionBy("region").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    gap = grid.withColumn("gap", F.abs(upto / c("total") - 0.5))
    best = gap.groupBy("region").agg(F.min(F.struct(F.round("gap", 10).alias("r"), c("i"), c("gap"))).alias("m"))
    return best.select("region", c("m.i").alias("best"), F.round("m.gap", 8).alias("gap"))


_NULLS = 200
_SHUFFLED = f"""chg AS (SELECT a.grp, a.rate AS start, b.rate - a.rate AS x FROM panel a JOIN panel b ON a.grp = b.grp AND a.period = 1996 AND b.period = 2000),
mid AS (SELECT median(start) AS m FROM chg),
obs AS (SELECT avg(x) FILTER (WHERE start >= m) - avg(x) FILTER (WHERE start < m) AS stat FROM chg, mid),
nul AS (SELECT CAST(t.i AS INTEGER) AS draw, avg(x) FILTER (WHERE u < 0.5) - avg(x) FILTER (WHERE u >= 0.5) AS stat FROM (SELECT t.i, x, {_hash_sql("CAST(t.i AS VARCHAR)", "grp")} AS u FROM chg, range(0, {_NULLS}) t(i)) t GROUP BY t.i)"""


@query(
    "opt08b_null_and_power",
    with_tables(
        _SHUFFLED + ", bar AS (SELECT quantile_cont(stat, 0.95) AS bar FROM nul)",
        "SELECT delta, round((1 + count(*) FILTER (WHERE nul.stat >= obs.stat)) / CAST(1 + count(*) AS DOUBLE), 8) AS p, round(avg(CASE WHEN nul.stat + delta > bar THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 8) AS power FROM nul, obs, bar, (VALUES (CAST(0 AS DOUBLE)), (CAST(0.25 AS DOUBLE)), (CAST(0.5 AS DOUBLE)), (CAST(1 AS DOUBLE))) t(delta) GROUP BY delta",
    ),
)
def opt08b(spark, d):
    """One-sided p against shuffled sides, and power by effect over the same null draws."""
    p = panel(spark, d)
    start = p.where("period = 1996").select("grp", c("rate").alias("start"))
    chg = p.where("period = 2000").select("grp", c("rate").alias("end")).join(start, "grp").select("grp", "start", (c("end") - c("start")).alias("x"))
    gap = lambda side: F.avg(F.when(side, c("x"))) - F.avg(F.when(~side, c("x")))
    obs = chg.crossJoin(F.broadcast(chg.agg(F.percentile("start", F.lit(0.5)).alias("m")))).agg(gap(c("start") >= c("m")).alias("obs"))
    draws = chg.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(_NULLS - 1)))).withColumn("u", rng.hash_uniform(c("draw"), c("grp")))
    null = draws.groupBy("draw").agg(gap(c("u") < 0.5).alias("stat"))
    ruled = null.crossJoin(F.broadcast(obs)).crossJoin(F.broadcast(null.agg(F.percentile("stat", F.lit(0.95)).alias("bar"))))
    each = ruled.withColumn("delta", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 1.0)])))
    pv = (1 + F.count_if(c("stat") >= c("obs"))) / (1 + F.count("*"))
    return each.groupBy("delta").agg(F.round(pv, 8).alias("p"), F.round(F.avg((c("stat") + c("delta") > c("bar")).cast("double")), 8).alias("power"))


_CUTS = (6.0, 8.0, 10.0)
_WINDOWS = f"""now AS (SELECT grp, rate FROM panel WHERE period = 2000),
prob AS (SELECT grp, rate, cut, avg(CASE WHEN rate + 6 * (u - 0.5) < cut THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS p FROM (SELECT grp, rate, {_hash_sql("CAST(t.i AS VARCHAR)", "grp")} AS u FROM now, range(0, 100) t(i)), (VALUES {", ".join(f"(CAST({x} AS DOUBLE))" for x in _CUTS)}) v(cut) GROUP BY grp, rate, cut),
win AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(abs(rate - cut), 9), cut) AS k, count(*) OVER (PARTITION BY grp) AS n FROM prob WHERE p BETWEEN 0.10 AND 0.90)"""


@query("opt10b_roster_windows", with_tables(_WINDOWS, "SELECT grp, cut, CASE WHEN rate >= cut THEN 'above' ELSE 'below' END AS side, round(p, 8) AS p, n AS windows, n > 1 AS reassigned, round(abs(rate - cut), 6) AS distance FROM win WHERE k = 1"))
def opt10b(spark, d):
    """Groups whose draws fall below a cut with a chance of 0.10 to 0.90, each assigned to its nearest such cut."""
    now = panel(spark, d).where("period = 2000").select("grp", "rate", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("draw"))
    drawn = c("rate") + 6 * (rng.hash_uniform(c("draw"), c("grp")) - 0.5)
    shares = now.groupBy("grp", "rate").agg(*[F.avg((drawn < x).cast("double")).alias(f"p{i}") for i, x in enumerate(_CUTS)])
    cells = F.array(*[F.struct(F.round(F.abs(c("rate") - x), 9).alias("far"), F.lit(x).alias("cut"), c(f"p{i}").alias("p")) for i, x in enumerate(_CUTS)])
    held = shares.withColumn("w", F.array_sort(F.filter(cells, lambda s: s["p"].between(0.10, 0.90)))).where(F.size("w") > 0)
    near = F.get("w", F.lit(0))
    return held.select("grp", near["cut"].alias("cut"), F.when(c("rate") >= near["cut"], "above").otherwise("below").alias("side"), F.round(near["p"], 8).alias("p"), F.size("w").cast("long").alias("windows"), (F.size("w") > 1).alias("reassigned"), F.round(F.abs(c("rate") - near["cut"]), 6).alias("distance"))


_DONOR = """chan AS (SELECT grp, period, unnest(['over', 'under', 'all']) AS outcome, unnest([sum(CASE WHEN status = 2 THEN weight * err ELSE 0 END), sum(CASE WHEN status = 3 THEN weight * err ELSE 0 END), sum(weight * err)]) * 100 / sum(weight * base) AS y FROM cases WHERE period <= 2000 GROUP BY grp, period),
far AS (SELECT a.grp AS unit, b.grp AS donor, 1 / (CAST(0.1 AS DOUBLE) + sqrt(avg((a.y - b.y) * (a.y - b.y)))) AS v FROM chan a JOIN chan b ON a.grp <> b.grp AND a.period = b.period AND a.outcome = 'over' AND b.outcome = 'over' WHERE a.period <= 1997 GROUP BY 1, 2),
wts AS (SELECT unit, donor, v / sum(v) OVER (PARTITION BY unit) AS w FROM far WHERE donor NOT IN ('NATION_7', 'NATION_12')),
gap AS (SELECT unit, a.outcome, a.period, any_value(a.y) - sum(w * b.y) AS g FROM wts JOIN chan a ON a.grp = unit JOIN chan b ON b.grp = donor AND b.period = a.period AND b.outcome = a.outcome GROUP BY 1, 2, 3),
eff AS (SELECT unit, outcome, avg(g) FILTER (WHERE period > 1997) - avg(g) FILTER (WHERE period <= 1997) AS effect, sqrt(avg(g * g) FILTER (WHERE period <= 1997)) AS rmspe FROM gap GROUP BY 1, 2),
own AS (SELECT outcome, avg(effect) AS pooled FROM eff WHERE unit IN ('NATION_7', 'NATION_12') GROUP BY outcome),
pla AS (SELECT a.outcome, (a.effect + b.effect) / 2 AS x FROM eff a JOIN eff b ON a.outcome = b.outcome AND a.unit < b.unit WHERE a.unit NOT IN ('NATION_7', 'NATION_12') AND b.unit NOT IN ('NATION_7', 'NATION_12')),
pv AS (SELECT o.outcome, any_value(pooled) AS pooled, (1 + count(*) FILTER (WHERE round(abs(x), 9) >= round(abs(pooled), 9))) / CAST(1 + count(*) AS DOUBLE) AS p FROM own o JOIN pla USING (outcome) GROUP BY o.outcome)"""


@query("opt04b_fixed_donors", with_tables(_DONOR, "SELECT outcome, round(pooled, 6) + 0.0 AS pooled, round(p, 8) AS p, CASE WHEN p <= 0.10 / 3 THEN 'family' WHEN p <= 0.10 THEN 'nominal' ELSE 'none' END AS signal FROM pv"))
def opt04b(spark, d):
    """Donor weights fixed once by pre-period nearness in one outcome and applied unchanged to all; two
    treated units pooled, against the pooled effects of all pairs of donors; p judged at 0.10 and at a third of it."""
    treated = ["NATION_7", "NATION_12"]
    w = c("weight") * c("err")
    sums = cases(spark, d).where("period <= 2000").groupBy("grp", "period").agg(F.sum(F.when(c("status") == 2, w).otherwise(0.0)).alias("over"), F.sum(F.when(c("status") == 3, w).otherwise(0.0)).alias("under"), F.sum(w).alias("all"), F.sum(c("weight") * c("base")).alias("b"))
    chan = sums.select("grp", "period", F.inline(F.array(*[F.struct(F.lit(n).alias("outcome"), (c(n) * 100 / c("b")).alias("y")) for n in ("over", "under", "all")])))
    fit = chan.where("outcome = 'over' AND period <= 1997")
    a, b = fit.select(c("grp").alias("unit"), "period", c("y").alias("ya")), fit.select(c("grp").alias("donor"), "period", c("y").alias("yb"))
    far = a.join(b, "period").where("unit <> donor").groupBy("unit", "donor").agg((1 / (0.1 + F.sqrt(F.avg((c("ya") - c("yb")) * (c("ya") - c("yb")))))).alias("v"))
    far = far.where(~c("donor").isin(*treated))
    weights = far.join(far.groupBy("unit").agg(F.sum("v").alias("s")), "unit").select("unit", "donor", (c("v") / c("s")).alias("w"))
    synthetic = weights.join(chan.withColumnRenamed("grp", "donor"), "donor").groupBy("unit", "outcome", "period").agg(F.sum(c("w") * c("y")).alias("synthetic"))
    gaps = synthetic.join(chan.withColumnRenamed("grp", "unit"), ["unit", "outcome", "period"]).withColumn("g", c("y") - c("synthetic"))
    effect = F.avg(F.when(c("period") > 1997, c("g"))) - F.avg(F.when(c("period") <= 1997, c("g")))
    eff = gaps.groupBy("unit", "outcome").agg(effect.alias("effect"))
    own = eff.where(c("unit").isin(*treated)).groupBy("outcome").agg(F.avg("effect").alias("pooled"))
    rest = eff.where(~c("unit").isin(*treated))
    pairs = rest.alias("a").join(rest.alias("b"), (c("a.outcome") == c("b.outcome")) & (c("a.unit") < c("b.unit"))).select(c("a.outcome").alias("outcome"), ((c("a.effect") + c("b.effect")) / 2).alias("x"))
    hits = F.count_if(F.round(F.abs("x"), 9) >= F.round(F.abs("pooled"), 9))
    p = pairs.join(own, "outcome").groupBy("outcome").agg(F.first("pooled").alias("pooled"), ((1 + hits) / (1 + F.count("*"))).alias("p"))
    return p.select("outcome", (F.round("pooled", 6) + 0.0).alias("pooled"), F.round("p", 8).alias("p"), F.when(c("p") <= 0.10 / 3, "family").when(c("p") <= 0.10, "nominal").otherwise("none").alias("signal"))


_BENT = (0.0, 0.6, -0.4, 0.0, 0.3, -0.6, 0.2, 0.0, -0.5)


def _bent_sql() -> str:
    return "[" + ", ".join(f"q[{i + 1}] + CAST({b} AS DOUBLE)" for i, b in enumerate(_BENT)) + "]"


def _pava_sql(v: str, i: int) -> str:
    mean = lambda j, k: "(" + " + ".join(f"{v}[{t + 1}]" for t in range(j, k + 1)) + f") / {k - j + 1}"
    return "greatest(" + ", ".join("least(" + ", ".join(mean(j, k) for k in range(i, 9)) + ")" for j in range(i + 1)) + ")"


@query("qnt09b_isotonic_rows", with_tables(_Q + f", b AS (SELECT case_id, {_bent_sql()} AS v FROM q)", "SELECT case_id, " + ", ".join(f"round(greatest({_pava_sql('v', i)}, ln(CAST(30 AS DOUBLE))), 8) AS q{i}" for i in (0, 2, 5, 8)) + " FROM b"))
def qnt09b(spark, d):
    """A level profile is added to each row's quantiles and the row projected onto rising ones."""
    rows = _quantiles(spark, d).withColumn("v", F.transform("q", lambda x, i: x + F.get(F.array(*[F.lit(b) for b in _BENT]), i)))
    iso = rows.select("case_id", Q.isotonic(c("v"), len(_BENT)).alias("v"))
    return iso.select("case_id", *[F.round(F.greatest(F.get("v", F.lit(i)), F.ln(F.lit(30.0))), 8).alias(f"q{i}") for i in (0, 2, 5, 8)])


_SPREAD = "[" + ", ".join(f"q[5] + CAST(1.2 AS DOUBLE) * (q[{i}] - q[5])" for i in range(1, 10)) + "]"
_COVER = f"""cov AS (SELECT kind, level, 100 * (sum(CASE WHEN amount <= 0 OR ln(amount) <= v[k] THEN weight ELSE 0 END) / sum(weight) - level) AS gap FROM (SELECT weight, amount, unnest(['base', 'spread']) AS kind, unnest([q, {_SPREAD}]) AS v FROM q), (VALUES {", ".join(f"({i + 1}, CAST({p} AS DOUBLE))" for i, p in enumerate(Q.LEVELS))}) t(k, level) GROUP BY kind, level)"""


@query("x04_repaired_coverage", with_tables(_Q + ", " + _COVER, "SELECT kind, round(avg(abs(gap)), 6) AS mean_gap, round(max(abs(gap)), 6) AS most, count(*) FILTER (WHERE gap < 0) AS negative, count(*) FILTER (WHERE gap > 0) AS positive FROM cov GROUP BY kind"))
def x04(spark, d):
    """Coverage before and after quantiles are repaired: mean and largest gap, and their signs."""
    return _coverage(_quantiles(spark, d)).groupBy("kind").agg(F.round(F.avg(F.abs("gap")), 6).alias("mean_gap"), F.round(F.max(F.abs("gap")), 6).alias("most"), F.count_if(c("gap") < 0).alias("negative"), F.count_if(c("gap") > 0).alias("positive"))


def _coverage(rows: DataFrame) -> DataFrame:
    """(kind, level, gap in points) of the plain and the spread quantiles, every level in one pass."""
    kinds = {"base": c("q"), "spread": Q.spread_about_median(c("q"), F.lit(1.2))}
    w = c("weight")
    hit = lambda v, i: F.sum(F.when((c("amount") <= 0) | (F.ln("amount") <= F.get(v, F.lit(i))), w).otherwise(0.0)) / F.sum(w)
    sums = rows.agg(*[hit(v, i).alias(f"{k}{i}") for k, v in kinds.items() for i in range(len(Q.LEVELS))])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(p).alias("level"), (100 * (c(f"{k}{i}") - p)).alias("gap")) for k in kinds for i, p in enumerate(Q.LEVELS)])))


@query(
    "ml12b_guarded_verdict",
    with_tables(
        _Q + ", " + _COVER + ", m AS (SELECT kind, avg(abs(gap)) AS mean_gap, max(abs(gap)) AS most FROM cov GROUP BY kind)",
        "SELECT s.mean_gap <= b.mean_gap AS better, s.most <= b.most + 0.05 AS guarded, round(b.mean_gap - s.mean_gap, 6) + 0.0 AS improvement, CASE WHEN s.most <= b.most + 0.05 AND b.mean_gap - s.mean_gap >= 0.25 THEN 'USE spread' ELSE 'RETAIN BASELINE' END AS verdict FROM m s, m b WHERE s.kind = 'spread' AND b.kind = 'base'",
    ),
)
def ml12b(spark, d):
    """The candidate of the least mean gap is used if its guard holds and it improves by a material amount."""
    m = _coverage(_quantiles(spark, d)).groupBy("kind").agg(F.avg(F.abs("gap")).alias("mean_gap"), F.max(F.abs("gap")).alias("most"))
    one = m.agg(*[F.max(F.when(c("kind") == k, c(v))).alias(f"{k}_{v}") for k in ("base", "spread") for v in ("mean_gap", "most")])
    gain, guard = c("base_mean_gap") - c("spread_mean_gap"), c("spread_most") <= c("base_most") + 0.05
    return one.select((gain >= 0).alias("better"), guard.alias("guarded"), (F.round(gain, 6) + 0.0).alias("improvement"), F.when(guard & (gain >= 0.25), "USE spread").otherwise("RETAIN BASELINE").alias("verdict"))


@query(
    "x05_level_profile",
    with_tables(_Q, " UNION ALL ".join(f"SELECT {i + 1} AS level_no, round(quantile_cont(ln(amount) - q[{i + 1}], {p}), 6) + 0.0 AS offset_log FROM q WHERE amount > 0" for i, p in enumerate(Q.LEVELS))),
)
def x05(spark, d):
    """Each level's offset: the quantile of the residuals at that level."""
    rows = store(cases(spark, d).where("amount > 0").select("amount", "line"), "residuals")
    fit = X.exact_percentiles(rows, {i + 1: (F.ln("amount") - ladder()[i], p) for i, p in enumerate(Q.LEVELS)})
    return fit.select("level_no", (F.round("value", 6) + 0.0).alias("offset_log"))


@query("x01b_full_process", with_tables(_Q + ", t AS (SELECT *, 1000 + 100 * (period - 1995) AS thr FROM q JOIN (SELECT case_id AS i, period FROM cases) ON case_id = i)", f"SELECT case_id, round(least(CAST(0.95 AS DOUBLE), score * 10), 8) AS p_dev, round(least(CAST(0.95 AS DOUBLE), score * 10) * ({_survival_sql('ln(thr)')}), 8) AS uncapped, round(CASE WHEN base * 0.1 <= thr THEN 0 ELSE least(CAST(0.95 AS DOUBLE), score * 10) * ({_survival_sql('ln(thr)')}) END, 8) AS crosses, round(least(exp(q[5]), base * 0.1), 6) AS median_dollars FROM t"))
def x01b(spark, d):
    """Deviation chance by case, crossing of the period's threshold with and without the cap, and the capped median."""
    p = F.least(F.lit(0.95), c("score") * 10)
    thr = (1000 + 100 * (c("period") - 1995)).cast("double")
    above = p * Q.survival(thr, c("q"), F.lit(0.4))
    return _quantiles(spark, d).select("case_id", F.round(p, 8).alias("p_dev"), F.round(above, 8).alias("uncapped"), F.round(F.when(c("base") * 0.1 <= thr, 0.0).otherwise(above), 8).alias("crosses"), F.round(F.least(F.exp(F.get("q", F.lit(4))), c("base") * 0.1), 6).alias("median_dollars"))


@query(
    "ml03b_fitted_smearing",
    with_tables(
        "f AS (SELECT grp, regr_slope(y * sw, x * sw) AS unused, (sum(w) * sum(w * x * y) - sum(w * x) * sum(w * y)) / (sum(w) * sum(w * x * x) - sum(w * x) * sum(w * x)) AS slope, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy FROM (SELECT grp, weight AS w, sqrt(weight) AS sw, ln(base) AS x, ln(amount) AS y FROM cases WHERE amount > 0) GROUP BY grp)",
        "SELECT grp, round(slope, 6) AS slope, round(sum(weight * exp(ln(amount) - ((sy - slope * sx) / sw + slope * ln(base)))) / sum(weight), 6) AS smear FROM cases JOIN f USING (grp) WHERE amount > 0 GROUP BY grp, slope",
    ),
)
def ml03b(spark, d):
    """Log magnitude regressed by weight on log base, and the smearing factor of its residuals."""
    rows = cases(spark, d).where("amount > 0").select("grp", c("weight").alias("w"), F.ln("base").alias("x"), F.ln("amount").alias("y"))
    w, x, y = c("w"), c("x"), c("y")
    f = rows.groupBy("grp").agg(*[F.sum(e).alias(n) for n, e in {"sw": w, "sx": w * x, "sy": w * y, "sxx": w * x * x, "sxy": w * x * y}.items()])
    f = f.withColumn("slope", (c("sw") * c("sxy") - c("sx") * c("sy")) / (c("sw") * c("sxx") - c("sx") * c("sx"))).withColumn("level", (c("sy") - c("slope") * c("sx")) / c("sw"))
    smear = F.sum(w * F.exp(y - (c("level") + c("slope") * x))) / F.sum(w)
    return rows.join(f.select("grp", "slope", "level"), "grp").groupBy("grp", "slope").agg(F.round(smear, 6).alias("smear")).select("grp", F.round("slope", 6).alias("slope"), "smear")


@query(
    "ml07b_head_to_head",
    with_tables(
        "o AS (SELECT a.grp, a.period, a.rate, avg(b.rate) AS own FROM panel a JOIN panel b ON a.grp = b.grp AND a.period <> b.period GROUP BY 1, 2, 3), g AS (SELECT a.period, avg(b.rate) AS grand FROM (SELECT DISTINCT period FROM panel) a JOIN panel b ON a.period <> b.period GROUP BY 1), "
        "e AS (SELECT unnest(['own', 'grand']) AS model, unnest([rate - own, rate - grand]) AS r FROM o JOIN g USING (period)), m AS (SELECT model, avg(abs(r)) AS mae, sqrt(avg(r * r)) AS rmse, max(abs(r)) AS most FROM e GROUP BY model)",
        "SELECT a.model, round(a.mae, 6) AS mae, round(a.rmse, 6) AS rmse, round(a.most, 6) AS most, CASE WHEN a.mae < b.mae AND a.rmse <= b.rmse AND a.most <= b.most THEN 'wins' WHEN b.mae < a.mae AND b.rmse <= a.rmse AND b.most <= a.most THEN 'loses' ELSE 'undecided' END AS verdict FROM m a JOIN m b ON a.model <> b.model",
    ),
)
def ml07b(spark, d):
    """Two left-out predictors on three lower-is-better metrics; one wins only if every gate agrees."""
    p = panel(spark, d)
    by_group = p.groupBy("grp").agg(F.sum("rate").alias("gs"), F.count("*").alias("gn"))
    by_period = p.groupBy("period").agg(F.sum("rate").alias("ps"), F.count("*").alias("pn"))
    whole = p.agg(F.sum("rate").alias("s"), F.count("*").alias("all"))
    j = p.join(by_group, "grp").join(by_period, "period").crossJoin(F.broadcast(whole)).where("gn > 1")
    r = c("rate")
    e = j.select(F.inline(F.array(F.struct(F.lit("own").alias("model"), (r - (c("gs") - r) / (c("gn") - 1)).alias("r")), F.struct(F.lit("grand").alias("model"), (r - (c("s") - c("ps")) / (c("all") - c("pn"))).alias("r")))))
    m = e.groupBy("model").agg(F.avg(F.abs("r")).alias("mae"), F.sqrt(F.avg(c("r") * c("r"))).alias("rmse"), F.max(F.abs("r")).alias("most"))
    a, b = m.alias("a"), m.alias("b")
    beats = lambda x, y: (c(f"{x}.mae") < c(f"{y}.mae")) & (c(f"{x}.rmse") <= c(f"{y}.rmse")) & (c(f"{x}.most") <= c(f"{y}.most"))
    verdict = F.when(beats("a", "b"), "wins").when(beats("b", "a"), "loses").otherwise("undecided")
    return a.join(b, c("a.model") != c("b.model")).select("a.model", *[F.round(f"a.{k}", 6).alias(k) for k in ("mae", "rmse", "most")], verdict.alias("verdict"))


@query(
    "opt11b_telescoping_ladder",
    "SELECT grp, round(b - a, 6) + 0.0 AS threshold_step, round(e - b, 6) + 0.0 AS price_step, round(f - e, 6) + 0.0 AS weight_step, round(f - a, 6) + 0.0 AS total FROM (SELECT grp, sum(weight * CASE WHEN amount > 1000 THEN amount ELSE 0 END) * 100 / sum(weight * base) AS a, sum(weight * CASE WHEN amount > 1500 THEN amount ELSE 0 END) * 100 / sum(weight * base) AS b, sum(weight * CASE WHEN amount > 1500 THEN amount ELSE 0 END) * 100 / sum(weight * base * CAST(1.1 AS DOUBLE)) AS e, sum(weight * line * CASE WHEN amount > 1500 THEN amount ELSE 0 END) * 100 / sum(weight * line * base * CAST(1.1 AS DOUBLE)) AS f FROM cases GROUP BY grp)",
)
def opt11b(spark, d):
    """Threshold, prices and weights moved one after the other: the steps add up to the whole move."""
    over = lambda t: F.when(c("amount") > t, c("amount")).otherwise(0.0)
    priced = c("base") * 1.1
    g = cases(spark, d).groupBy("grp").agg(R.weighted_ratio("weight", over(1000), "base").alias("a"), R.weighted_ratio("weight", over(1500), "base").alias("b"), R.weighted_ratio("weight", over(1500), priced).alias("e"), R.weighted_ratio(c("weight") * c("line"), over(1500), priced).alias("f"))
    step = lambda x, y, n: (F.round(c(y) - c(x), 6) + 0.0).alias(n)
    return g.select("grp", step("a", "b", "threshold_step"), step("b", "e", "price_step"), step("e", "f", "weight_step"), step("a", "f", "total"))


@query("snk06_memo_lines", f"SELECT grp, '| ' || grp || ' | ' || CAST(rate AS VARCHAR) || ' | ' || CAST({TIER_SQL.format('rate')} AS VARCHAR) || ' |' AS line FROM (SELECT grp, round(max(rate), 2) AS rate FROM panel GROUP BY grp)")
def snk06(spark, d):
    """A report's table, rendered from the artifact's rows alone."""
    top = panel(spark, d).groupBy("grp").agg(F.round(F.max("rate"), 2).alias("rate"))
    return top.select("grp", F.concat(F.lit("| "), "grp", F.lit(" | "), c("rate").cast("string"), F.lit(" | "), S.tier(c("rate")).cast("string"), F.lit(" |")).alias("line"))


@query("x08_fixed_weight_path", "SELECT a.period, round(any_value(a.rate), 6) AS treated, round(avg(b.rate), 6) AS donors, round(any_value(a.rate) - avg(b.rate), 6) + 0.0 AS gap FROM panel a JOIN panel b ON a.period = b.period AND b.grp_no % 5 = a.grp_no % 5 AND b.grp <> a.grp WHERE a.grp = 'NATION_7' GROUP BY a.period")
def x08(spark, d):
    """A group's path beside that of fixed donors in equal parts."""
    p = panel(spark, d)
    own = p.where("grp = 'NATION_7'").select("period", c("rate").alias("treated"), (c("grp_no") % 5).alias("kin"))
    rest = p.where("grp <> 'NATION_7'").select("period", "rate", (c("grp_no") % 5).alias("kin"))
    g = rest.join(own, ["period", "kin"]).groupBy("period").agg(F.first("treated").alias("t"), F.avg("rate").alias("m"))
    return g.select("period", F.round("t", 6).alias("treated"), F.round("m", 6).alias("donors"), (F.round(c("t") - c("m"), 6) + 0.0).alias("gap"))


_CHECKED = ("weight", "base", "discount", "score", "amount")


@query("x16_feature_validation", " UNION ALL ".join(f"SELECT '{n}' AS feature, count(*) AS n, count(*) FILTER (WHERE {n} IS NULL OR NOT isfinite({n})) AS bad, count(*) FILTER (WHERE {n} < 0) AS negative FROM cases WHERE err > 0" for n in _CHECKED))
def x16(spark, d):
    """Deviating cases' features: how many, how many missing or not finite, how many negative; one pass for all."""
    rows = cases(spark, d).where("err > 0")
    bad = lambda n: c(n).isNull() | F.isnan(n) | (F.abs(n) == float("inf"))
    s = rows.agg(F.count("*").alias("n"), *[F.count_if(bad(n)).alias(f"b_{n}") for n in _CHECKED], *[F.count_if(c(n) < 0).alias(f"n_{n}") for n in _CHECKED])
    return s.select(F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), c("n"), c(f"b_{n}").alias("bad"), c(f"n_{n}").alias("negative")) for n in _CHECKED])))


@query("x17_process_validation", with_tables(_Q, "SELECT grp, count(*) AS n, count(*) FILTER (WHERE NOT (score * 10 BETWEEN 0 AND 1)) AS bad_probability, count(*) FILTER (WHERE list_sort(q) <> q) AS falling, count(*) FILTER (WHERE base * 0.1 < abs(amount) AND amount > 0) AS over_cap FROM q GROUP BY grp"))
def x17(spark, d):
    """Inputs of the predictive process: probabilities in bounds, quantiles rising, amounts within the cap."""
    return _quantiles(spark, d).groupBy("grp").agg(F.count("*").alias("n"), F.count_if(~(c("score") * 10).between(0, 1)).alias("bad_probability"), F.count_if(F.array_sort("q") != c("q")).alias("falling"), F.count_if((c("base") * 0.1 < F.abs("amount")) & (c("amount") > 0)).alias("over_cap"))


@query("x20_quantised_state", "SELECT grp, period, CAST(round(rate * 1000) AS BIGINT) AS rate_q, CAST(round(w) AS BIGINT) AS weight_q, round(abs(rate - round(rate * 1000) / 1000), 9) <= 0.0005 AS within FROM panel")
def x20(spark, d):
    """A state's numbers as whole thousandths, with the error this makes checked."""
    q = F.round(c("rate") * 1000)
    return panel(spark, d).select("grp", "period", q.cast("long").alias("rate_q"), F.round("w").cast("long").alias("weight_q"), (F.round(F.abs(c("rate") - q / 1000), 9) <= 0.0005).alias("within"))


@query("x21_lift_and_contrast", "SELECT grp, round((avg(CASE WHEN err > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE line = 3)) / avg(CASE WHEN err > 0 THEN 1.0 ELSE 0.0 END), 6) AS lift, round(sum(weight * err) FILTER (WHERE line = 3) / sum(weight) FILTER (WHERE line = 3) - sum(weight * err) FILTER (WHERE line <> 3) / sum(weight) FILTER (WHERE line <> 3), 4) + 0.0 AS contrast FROM cases GROUP BY grp")
def x21(spark, d):
    """A flagged class against all cases: lift of its error share, contrast of its mean dollars."""
    flag, hit = c("line") == 3, (c("err") > 0).cast("double")
    mean = lambda m: F.try_divide(F.sum(F.when(m, c("weight") * c("err"))), F.sum(F.when(m, c("weight"))))
    return cases(spark, d).groupBy("grp").agg(F.round(F.avg(F.when(flag, hit)) / F.avg(hit), 6).alias("lift"), (F.round(mean(flag) - mean(~flag), 4) + 0.0).alias("contrast"))


@query("x22_compact_totals", "SELECT status, count(*) AS n, round(sum(amount), 2) AS total, round(min(amount), 6) + 0.0 AS least, round(max(amount), 6) + 0.0 AS most, count(*) FILTER (WHERE amount > 0) AS positive, count(*) FILTER (WHERE err > 0) AS counted FROM cases GROUP BY status")
def x22(spark, d):
    a = c("amount")
    return cases(spark, d).groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum(a), 2).alias("total"), (F.round(F.min(a), 6) + 0.0).alias("least"), (F.round(F.max(a), 6) + 0.0).alias("most"), F.count_if(a > 0).alias("positive"), F.count_if(c("err") > 0).alias("counted"))


@query("x14b_unique_mode", "SELECT CASE WHEN f = n AND ce < n AND h < n THEN 'floor' WHEN ce = n AND f < n AND h < n THEN 'ceil' WHEN h = n AND f < n AND ce < n THEN 'half_up' ELSE 'none' END AS mode, n FROM (SELECT count(*) AS n, count(*) FILTER (WHERE p = floor(x)) AS f, count(*) FILTER (WHERE p = ceil(x)) AS ce, count(*) FILTER (WHERE p = floor(x + 0.5)) AS h FROM (SELECT base / 7 AS x, floor(base / 7 + 0.5) AS p FROM cases))")
def x14b(spark, d):
    """The one rounding mode that gives every published number; none if several or none do."""
    x = c("base") / 7
    modes = {"floor": F.floor(x), "ceil": F.ceil(x), "half_up": F.floor(x + 0.5)}
    n = cases(spark, d).agg(F.count("*").alias("n"), *[F.count_if(F.floor(x + 0.5) == m).alias(k) for k, m in modes.items()])
    fits = F.filter(F.array(*[F.when(c(k) == c("n"), F.lit(k)) for k in modes]), lambda k: k.isNotNull())
    return n.select(F.when(F.size(fits) == 1, F.get(fits, F.lit(0))).otherwise("none").alias("mode"), "n")


@query(
    "x13b_variant_grid",
    with_tables(
        _MULT + ", r AS (SELECT grp, draw, sum(we) * 100 / sum(wb) AS rate FROM mult GROUP BY grp, draw)",
        " UNION ALL ".join([f"SELECT grp, 'q' AS kind, CAST({i} AS INTEGER) AS k, round(quantile_cont(rate, {i / 20}), 6) AS value FROM r GROUP BY grp" for i in range(1, 20)] + [f"SELECT grp, 'below' AS kind, CAST({i} AS INTEGER) AS k, CAST(count(*) FILTER (WHERE rate < {b}) AS DOUBLE) AS value FROM r GROUP BY grp" for i, b in enumerate((2, 3, 4, 5, 6, 7, 8, 10, 12))]),
    ),
)
def x13b(spark, d):
    """A variant's draws as nineteen quantiles and nine counts below a bound."""
    t = B.poisson_sums(cases(spark, d), ["grp"], "case_id", 10, we=c("weight") * c("err"), wb=c("weight") * c("base"))
    r = t.select("grp", (c("we") * 100 / c("wb")).alias("rate"))
    g = r.groupBy("grp").agg(F.percentile("rate", F.array(*[F.lit(i / 20) for i in range(1, 20)])).alias("q"), *[F.count_if(c("rate") < b).cast("double").alias(f"b{i}") for i, b in enumerate((2, 3, 4, 5, 6, 7, 8, 10, 12))])
    item = lambda kind, k, v: F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("k"), v.alias("value"))
    rows = [item("q", i, F.round(F.get("q", F.lit(i - 1)), 6)) for i in range(1, 20)] + [item("below", i, c(f"b{i}")) for i in range(9)]
    return g.select("grp", F.inline(F.array(*rows)))


@query("ml10b_ranked_metrics", with_tables("s AS (SELECT grp, score, sum(CASE WHEN err > 0 THEN weight ELSE 0 END) AS pos, sum(CASE WHEN err > 0 THEN 0 ELSE weight END) AS neg FROM cases GROUP BY grp, score), t AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY grp) AS pa, sum(neg) OVER (PARTITION BY grp) AS na FROM s WINDOW w AS (PARTITION BY grp ORDER BY score DESC ROWS UNBOUNDED PRECEDING))", "SELECT grp, round(sum(neg * (tp - pos / 2)) / max(pa * na), 8) AS auc, round(sum(pos / pa * tp / (tp + fp)), 8) AS average_precision FROM t GROUP BY grp"))
def ml10b(spark, d):
    rows = cases(spark, d).withColumn("y", (c("err") > 0).cast("double"))
    return X.ranking_metrics(rows, ["grp"], "score", "y", "weight").select("grp", F.round("auc", 8).alias("auc"), F.round("average_precision", 8).alias("average_precision"))


_BASICS = """f0 AS (SELECT *, CASE WHEN agency1 * 5 - 20 >= 0 THEN agency1 * 5 - 20 END AS medical, coalesce(agency2, line) AS size, part % 4 = 0 OR supp % 5 = 0 AS frail, grp_no % 3 = 0 AS standard, grp_no % 2 = 0 AS broad, score > 0 AS earns, line % 3 = 0 AS children, part % 14 AS months FROM cases)"""


@query(
    "prj16b_feature_build",
    with_tables(
        _BASICS,
        """SELECT case_id, CAST(err > 0 AS INTEGER) AS official_error, round(deviation, 6) + 0.0 AS signed_deviation, weight AS w, size, CAST(agency2 IS NULL AS INTEGER) AS size_missing, CAST(frail AS INTEGER) AS frail, CAST(earns AS INTEGER) AS has_earnings, CAST(children AS INTEGER) AS children, CAST(line < 3 AS INTEGER) AS expedited,
        CAST(coalesce(medical > 0, FALSE) AS INTEGER) AS claims_medical, CAST(medical IS NULL AS INTEGER) AS medical_missing, CAST(coalesce(medical > 35, FALSE) AS INTEGER) AS above_floor, CAST(coalesce(medical > 35, FALSE) AND frail AND NOT standard AS INTEGER) AS documents,
        CAST(months BETWEEN 1 AND 12 AS INTEGER) AS period_valid, CASE WHEN months BETWEEN 1 AND 12 THEN CAST(months <= 6 AS INTEGER) END AS short_period, CASE WHEN months BETWEEN 1 AND 12 THEN CAST(months - month BETWEEN 0 AND 1 AS INTEGER) END AS near_end, CASE WHEN months BETWEEN 1 AND 12 THEN CAST(months <= 6 AND frail AS INTEGER) END AS short_frail,
        CAST(broad AS INTEGER) AS broad, CAST(broad AND frail AS INTEGER) AS broad_frail, CAST(broad AND earns AS INTEGER) AS broad_earns, CAST(broad AND children AS INTEGER) AS broad_children,
        CAST(CASE WHEN agency1 > 10 THEN 1 ELSE 0 END + CASE WHEN agency2 > 10 THEN 1 ELSE 0 END AS INTEGER) AS records, CAST((agency1 > 10 OR coalesce(agency2 > 10, FALSE)) <> (discount > 0.05) AS INTEGER) AS mismatch,
        CAST(agency2 IS NULL OR medical IS NULL AS INTEGER) AS parts_missing, CAST(CASE WHEN discount > 0 THEN 1 ELSE 0 END + CASE WHEN score > 0 THEN 1 ELSE 0 END + CASE WHEN medical > 0 THEN 1 ELSE 0 END + CASE WHEN agency2 > 0 THEN 1 ELSE 0 END AS INTEGER) AS parts,
        CAST(base >= 0.999 * 60000 AS INTEGER) AS at_max, CAST(base <= 1000.5 AS INTEGER) AS at_min, round(greatest(CAST(0 AS DOUBLE), least(base / 60000, CAST(1.5 AS DOUBLE))), 8) AS relative, CAST(amount <= 0 AS INTEGER) AS share_undefined, CASE WHEN amount <> 0 THEN round(least(CAST(2 AS DOUBLE), base * 0.05 / amount), 8) END AS net_share,
        round((discount * 1000 + score * 1000 + coalesce(medical, 0) + coalesce(agency2, 0)) / greatest(size, 1), 8) AS per_member FROM f0""",
    ),
)
def prj16b(spark, d):
    """The feature build: targets, covariates with flags for what is missing, interactions, clipped ratios."""
    i = lambda b: b.cast("int")
    no = F.lit(False)
    medical = F.when(c("agency1") * 5 - 20 >= 0, c("agency1") * 5 - 20)
    x = cases(spark, d).withColumns({"medical": medical, "size": F.coalesce("agency2", "line"), "frail": (c("part") % 4 == 0) | (c("supp") % 5 == 0), "standard": c("grp_no") % 3 == 0, "broad": c("grp_no") % 2 == 0, "earns": c("score") > 0, "kids": c("line") % 3 == 0, "months": c("part") % 14})
    valid, short, floor = c("months").between(1, 12), c("months") <= 6, F.coalesce(c("medical") > 35, no)
    second = F.coalesce(c("agency2") > 10, no)
    positive = lambda *cs: sum((F.when(k > 0, 1).otherwise(0) for k in cs), F.lit(0)).cast("int")
    out = {
        "official_error": i(c("err") > 0), "signed_deviation": F.round("deviation", 6) + 0.0, "w": c("weight"), "size": c("size"), "size_missing": i(c("agency2").isNull()), "frail": i(c("frail")), "has_earnings": i(c("earns")), "children": i(c("kids")), "expedited": i(c("line") < 3),
        "claims_medical": i(F.coalesce(c("medical") > 0, no)), "medical_missing": i(c("medical").isNull()), "above_floor": i(floor), "documents": i(floor & c("frail") & ~c("standard")),
        "period_valid": i(valid), "short_period": F.when(valid, i(short)), "near_end": F.when(valid, i((c("months") - c("month")).between(0, 1))), "short_frail": F.when(valid, i(short & c("frail"))),
        "broad": i(c("broad")), "broad_frail": i(c("broad") & c("frail")), "broad_earns": i(c("broad") & c("earns")), "broad_children": i(c("broad") & c("kids")),
        "records": positive(c("agency1") - 10, c("agency2") - 10), "mismatch": i(((c("agency1") > 10) | second) != (c("discount") > 0.05)),
        "parts_missing": i(c("agency2").isNull() | c("medical").isNull()), "parts": positive(c("discount"), c("score"), c("medical"), c("agency2")),
        "at_max": i(c("base") >= 0.999 * 60000), "at_min": i(c("base") <= 1000.5), "relative": F.round(F.greatest(F.lit(0.0), F.least(c("base") / 60000, F.lit(1.5))), 8), "share_undefined": i(c("amount") <= 0), "net_share": F.when(c("amount") != 0, F.round(F.least(F.lit(2.0), c("base") * 0.05 / c("amount")), 8)),
        "per_member": F.round((c("discount") * 1000 + c("score") * 1000 + F.coalesce(c("medical"), F.lit(0)) + F.coalesce(c("agency2"), F.lit(0))) / F.greatest(c("size"), F.lit(1)), 8),
    }
    return x.select("case_id", *[v.alias(k) for k, v in out.items()])


_KINDS = {"rounding": "abs(amount - base * 0.1) < 1", "settled": "abs(amount - base * 0.1) >= 1 AND status = 1", "above": "abs(amount - base * 0.1) >= 1 AND status <> 1 AND amount > base * 0.1", "below": "abs(amount - base * 0.1) >= 1 AND status <> 1 AND amount <= base * 0.1"}


@query("agg22b_checked_partition", "SELECT grp, " + ", ".join(f"count(*) FILTER (WHERE {k}) AS {n}" for n, k in _KINDS.items()) + ", " + " + ".join(f"count(*) FILTER (WHERE {k})" for k in _KINDS.values()) + " = count(*) AS disjoint, round(sum(weight) FILTER (WHERE abs(amount - base * 0.1) <= 5) / sum(weight), 8) AS concordance FROM cases GROUP BY grp")
def agg22b(spark, d):
    """A catalog whose parts are counted apart and checked to add up; and the weight within five dollars."""
    parts = {n: F.expr(k) for n, k in _KINDS.items()}
    near = F.abs(c("amount") - c("base") * 0.1) <= 5
    whole = sum((F.count_if(k) for k in parts.values()), F.lit(0)) == F.count("*")
    return cases(spark, d).groupBy("grp").agg(*[F.count_if(k).alias(n) for n, k in parts.items()], whole.alias("disjoint"), F.round(F.sum(F.when(near, c("weight"))) / F.sum("weight"), 8).alias("concordance"))


@query(
    "agg26b_contrast_by_adopter",
    with_tables(
        "y AS (SELECT grp, grp_no, period, weight, score, 1997 + grp_no % 3 AS adopted, line <= 2 AS exposed FROM cases), cell AS (SELECT grp, adopted, exposed, period >= adopted AS post, sum(weight * score) / sum(weight) AS x, count(*) AS n FROM y WHERE grp_no % 2 = 0 GROUP BY 1, 2, 3, 4)",
        "SELECT grp, adopted, CAST(sum(n) AS BIGINT) AS n, round(max(x) FILTER (WHERE exposed AND post) - max(x) FILTER (WHERE exposed AND NOT post) - max(x) FILTER (WHERE NOT exposed AND post) + max(x) FILTER (WHERE NOT exposed AND NOT post), 8) + 0.0 AS effect FROM cell GROUP BY grp, adopted",
    ),
)
def agg26b(spark, d):
    """Four weighted cells per adopter, before and after its own year, exposed and not; one pass for all."""
    rows = cases(spark, d).where("grp_no % 2 = 0").withColumn("adopted", 1997 + c("grp_no") % 3)
    mean = lambda e, p: R.weighted_mean(F.when(((c("line") <= 2) == e) & ((c("period") >= c("adopted")) == p), c("score")), "weight")
    effect = mean(True, True) - mean(True, False) - mean(False, True) + mean(False, False)
    return rows.groupBy("grp", "adopted").agg(F.count("*").alias("n"), (F.round(effect, 8) + 0.0).alias("effect"))


@query(
    "agg23b_divergence_histogram",
    "SELECT bin, count(*) AS n, min(case_id) AS exemplar FROM (SELECT case_id, CAST(greatest(-10, least(10, floor((amount - base * 0.05) / 500))) AS INTEGER) AS bin FROM cases) GROUP BY bin",
)
def agg23b(spark, d):
    """How far two computations diverge, in bands, with the first case of each."""
    band = F.greatest(F.lit(-10), F.least(F.lit(10), F.floor((c("amount") - c("base") * 0.05) / 500))).cast("int")
    return cases(spark, d).groupBy(band.alias("bin")).agg(F.count("*").alias("n"), F.min("case_id").alias("exemplar"))


@query(
    "agg18b_nature_by_slot",
    "SELECT nature, count(*) AS n, round(sum(weight * err), 2) AS dollars, round(count(*) / CAST((SELECT count(*) FROM cases) AS DOUBLE), 8) AS share FROM (SELECT weight, err, CASE WHEN k = 0 THEN 'none' WHEN h = k THEN 'all' WHEN h > 0 THEN 'some' ELSE 'clear' END AS nature FROM (SELECT weight, err, CASE WHEN agency1 IN (0, 5, 6, 9, 11, 13) THEN 0 ELSE 1 END + CASE WHEN agency2 IS NULL OR agency2 IN (0, 5, 6, 9, 11, 13) THEN 0 ELSE 1 END AS k, CASE WHEN agency1 IN (17, 19, 20) THEN 1 ELSE 0 END + CASE WHEN coalesce(agency2 IN (17, 19, 20), FALSE) THEN 1 ELSE 0 END AS h FROM cases)) GROUP BY nature",
)
def agg18b(spark, d):
    """Cases by whether none, all, some or no documented finding is of the strict kind; shares add up to one."""
    known = lambda s: s.isNotNull() & ~s.isin(0, 5, 6, 9, 11, 13)
    slots = F.filter(F.array("agency1", "agency2"), known)
    k, h = F.size(slots), F.size(F.filter(slots, lambda s: s.isin(*S.CODE_SETS["strict"])))
    nature = F.when(k == 0, "none").when(h == k, "all").when(h > 0, "some").otherwise("clear")
    g = cases(spark, d).groupBy(nature.alias("nature")).agg(F.count("*").alias("n"), F.round(F.sum(c("weight") * c("err")), 2).alias("dollars"))
    whole = g.agg(F.sum("n").alias("all"))
    return g.crossJoin(F.broadcast(whole)).select("nature", "n", "dollars", F.round(c("n") / c("all"), 8).alias("share"))
