"""The whole feature build over the case tables, and summaries of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import bootstrap as B
from ..operators import features as E
from ..operators import rates as R
from ..sources import contracts as M
from ..sources.cases import cases, table
from ..sources.shared import store
from .projections import TIER_SQL
from .registry import panel, query, with_tables
from .simulation import _RNG, DRAWS, SEED

c = F.col

#: A premium of each calendar year on the tables' scale.
PREMIUMS = {1995: 46.1, 1996: 42.5, 1997: 43.8, 1998: 43.8, 1999: 45.5, 2000: 45.5}
ELEMENT, IMPACTS = 305, [2, 3]
OFFICIAL = 9.0
FROM, UNTIL = 1996, 1997

#: Each role of a review as SQL over the case view, read by Spark and DuckDB alike.
ROLES = {
    "error": "err > 0", "paid": "base", "right": "base - deviation", "formula": "CASE WHEN part % 17 > 0 THEN base END", "weight": "weight", "year": "period", "state": "grp", "certified": "agency2", "unit": "CASE WHEN supp % 19 > 0 THEN line END",
    "elders": "part % 5 - 1", "disabled": "supp % 4 - 1", "earned": "CASE WHEN part % 7 > 0 THEN discount * 1000 END", "unearned": "CASE WHEN part % 9 > 0 THEN score * 1000 END", "gross": "CASE WHEN part % 11 > 0 THEN amount END", "net": "base * 0.05",
    "kids": "CASE WHEN supp % 13 > 0 THEN line % 3 END", "expedite": "CASE WHEN supp % 11 > 0 THEN agency1 % 4 END", "cert_months": "part % 14 - 1", "cert_since": "month - 2", "categorical": "agency1 % 5 - 1", "medical": "agency1 * 5 - 20", "demo": "supp % 3 - 1", "year_month": "period * 100 + CASE WHEN line = 6 THEN 13 ELSE month END",
    "self_total": "discount - 0.05", "utility": "CASE WHEN line < 7 THEN supp % 3 END", "medical_part": "CASE WHEN agency1 > 3 THEN agency1 * 1.5 END", "care_part": "discount * 100", "support_part": "agency2 * 1.0", "shelter_part": "score * 1000", "earned_part": "discount * 200", "most": "CASE WHEN line = 5 THEN 0 ELSE 60000 END", "least": "1000.0",
}
_SLOTS = ("agency1 - 10", "agency2 - 10", "line - 4")
_FINDINGS = [("300 + part % 8", "1 + supp % 3", "amount - 500"), ("300 + supp % 8", "1 + part % 3", "amount - 900")]


def reviews(spark, d) -> DataFrame:
    """The roles of the feature build for every case."""
    finding = lambda e, f, a: F.struct(F.expr(e).alias("element"), F.expr(f).alias("finding"), F.expr(a).alias("dollars"))
    listed = {"slots": F.array(*[F.expr(x) for x in _SLOTS]), "findings": F.array(*[finding(*x) for x in _FINDINGS])}
    return cases(spark, d).select("case_id", *[F.expr(x).alias(k) for k, x in ROLES.items()], *[x.alias(k) for k, x in listed.items()])


def registries(spark, d) -> dict[str, DataFrame]:
    """Places known to the registry (all but every eighth) and the years in which each has a policy."""
    nation = table(spark, d, "nation").select(c("n_name").alias("state"), c("n_nationkey").cast("int").alias("no"))
    years = nation.select("state", "no", F.explode(F.sequence(F.lit(1995), F.lit(2001))).alias("year"))
    premiums = spark.createDataFrame(list(PREMIUMS.items()), "calendar_year long, premium double")
    return {"states": nation.where("no % 8 <> 7"), "broad": years.where("(no + year) % 2 = 0"), "standard": years.where("no % 3 = 0 AND year >= 1997"), "premiums": premiums}


def _flag(sql: str) -> str:
    return f"CAST(coalesce({sql}, FALSE) AS INTEGER)"


_GONE = {k: f"CAST({v} IS NULL AS INTEGER)" for k, v in {"formula_benefit": "formula", "size": "size", "earned": "earned", "unearned": "unearned", "gross": "gross", "children": "kids", "expedited": "expedite", "months_since": "since_", "period_months": "months_", "categorical": "cat_", "claims_medical": "med_", "premium": "premium", "actual_utilities": "utility"}.items()}
_HIT = " OR ".join(f"coalesce({e} = {ELEMENT} AND {f} IN (2, 3) AND {a} > 0, FALSE)" for e, f, a in _FINDINGS)
_POSITIVE = lambda xs: " + ".join(f"CASE WHEN {x} > 0 THEN 1 ELSE 0 END" for x in xs)
_FOUR = ["medical_part", "care_part", "support_part", "shelter_part"]
_FEATURES_SQL = {
    "official_error": _flag("error"), "medical_error": _flag(f"error AND ({_HIT})"), "signed_deviation": "round(paid - \"right\", 6) + 0.0", "formula_benefit": "formula", "w": "weight",
    "size": "size", "frail_missing": _flag("eld_ IS NULL OR dis_ IS NULL"), "elders_present": _flag("eld_ > 0"), "frail": _flag("frail"), "earned": "earned", "unearned": "unearned", "gross": "round(gross, 6)", "has_earnings": _flag("earned > 0"), "children": _flag("kids > 0"), "expedited": _flag("expedite < 3"),
    "months_since": "CAST(since_ AS DOUBLE)", "period_months": "CAST(months_ AS DOUBLE)", "period_inconsistent": _flag("since_ >= months_"), "near_end": _flag("since_ < months_ AND since_ >= months_ - 2"), "near_end_missing": _flag("since_ IS NULL OR months_ IS NULL"), "near_end_frail": _flag("since_ < months_ AND since_ >= months_ - 2 AND frail"),
    "broad": _flag("is_broad"), "state_unknown": _flag("NOT known"), "broad_frail": _flag("is_broad AND frail"), "broad_earnings": _flag("is_broad AND earned > 0"), "broad_children": _flag("is_broad AND kids > 0"), "categorical_broad": _flag("cat_ IN (2, 3)"),
    "claims_medical": _flag("med_ > 0"), "above_floor": _flag("med_ > 35"), "documents": _flag("med_ > 35 AND frail AND NOT is_standard"),
    "premium_only": _flag("applies AND abs(med_ + 35 - premium) <= 5 + 1e-9"), "just_above_premium": _flag("applies AND med_ + 35 - premium > 5 + 1e-9 AND med_ + 35 - premium <= 50 + 1e-9"), "premium_distance": "CASE WHEN applies THEN round(abs(med_ + 35 - premium), 6) END", "premium": "premium", "rebuilt_expense": "CASE WHEN med_ > 0 THEN CAST(med_ + 35 AS DOUBLE) END", "premium_applies": _flag("applies"), "literal_premium_only": _flag("applies AND abs(med_ - premium) <= 5 + 1e-9"), "demo": _flag("supp % 3 - 1 = 1"),
    "records_missing": _flag(" AND ".join(f"({x}) IS NULL" for x in _SLOTS)), "records": f"CAST({_POSITIVE(_SLOTS)} AS INTEGER)", "total_has_income": _flag("self_total > 0"), "records_mismatch": _flag(f"({_POSITIVE(_SLOTS)} > 0) <> (self_total > 0)"), "actual_utilities": _flag("utility = 2"),
    "parts_missing": _flag(" OR ".join(f"{x} IS NULL" for x in _FOUR)), "parts": f"CAST({_POSITIVE(_FOUR)} AS INTEGER)", "deductions_missing": _flag(" OR ".join(f"{x} IS NULL" for x in [*_FOUR, "earned_part", "size"])), "per_member": "round((" + " + ".join(f"coalesce({x}, 0)" for x in [*_FOUR, "earned_part"]) + ") / CASE WHEN size IS NOT NULL THEN greatest(size, 1) END, 6)",
    "position_missing": _flag("formula IS NULL OR most IS NULL OR least IS NULL"), "at_max": _flag("formula / nullif(most, 0) >= 0.999"), "at_min": _flag("formula <= least + 0.5"), "of_most": "CASE WHEN formula / nullif(most, 0) IS NOT NULL THEN round(greatest(CAST(0 AS DOUBLE), least(formula / nullif(most, 0), CAST(1.5 AS DOUBLE))), 8) END", "net_share_undefined": _flag("net IS NULL OR gross IS NULL OR gross <= 0"), "net_share": "CASE WHEN net / nullif(gross, 0) IS NOT NULL THEN round(greatest(CAST(0 AS DOUBLE), least(net / nullif(gross, 0), CAST(2 AS DOUBLE))), 8) END",
} | {f"{k}_missing": v for k, v in _GONE.items()}
_TABLES = (
    "premiums(calendar_year, premium) AS (VALUES " + ", ".join(f"({y}, CAST({p} AS DOUBLE))" for y, p in PREMIUMS.items()) + "), roles AS (SELECT case_id, grp_no, part, supp, agency1, agency2, line, amount, " + ", ".join(f'{x} AS "{k}"' for k, x in ROLES.items()) + " FROM cases), "
    + "clean AS (SELECT *, " + ", ".join(f'CASE WHEN "{k}" >= 0 THEN "{k}" END AS {n}' for k, n in (("elders", "eld_"), ("disabled", "dis_"), ("cert_months", "months_"), ("cert_since", "since_"), ("categorical", "cat_"), ("medical", "med_")))
    + ", CASE WHEN year_month % 100 BETWEEN 1 AND 12 THEN year_month // 100 END AS calendar_year, coalesce(certified, unit) AS size, grp_no % 8 <> 7 AS known, grp_no % 8 <> 7 AND (grp_no + year) % 2 = 0 AS is_broad, grp_no % 3 = 0 AND year >= 1997 AS is_standard FROM roles), "
    + "feats AS (SELECT *, coalesce(eld_ > 0, FALSE) OR coalesce(dis_ > 0, FALSE) AS frail, coalesce(eld_ > 0, FALSE) AND coalesce(med_ > 0, FALSE) AND premium IS NOT NULL AS applies FROM clean LEFT JOIN premiums USING (calendar_year))"
)
_ROUND = {"signed_deviation": 6, "gross": 6, "premium_distance": 6, "per_member": 6, "of_most": 8, "net_share": 8}


def built(spark, d) -> DataFrame:
    return E.build(reviews(spark, d), ["case_id"], **registries(spark, d), medical_element=ELEMENT, impacts=IMPACTS)


@query("prj16c_whole_feature_build", with_tables(_TABLES, "SELECT case_id, state, year, " + ", ".join(f"{x} AS {k}" for k, x in _FEATURES_SQL.items()) + " FROM feats"))
def prj16c(spark, d):
    """Every target, covariate, flag, interaction and diagnostic of a review."""
    x = built(spark, d)
    return x.select(*[(F.round(k, _ROUND[k]) + 0.0 if k in _ROUND else c(k)).alias(k) for k in x.columns])


_LONG = ["documents", "near_end", "broad_children", "premium_only", "records_mismatch", "at_min", "net_share_undefined", "deductions_missing"]


@query("prj16d_feature_profile", with_tables(_TABLES + ", f AS (SELECT year, " + ", ".join(f"{_FEATURES_SQL[k]} AS {k}" for k in ["w", "official_error", *_LONG]) + " FROM feats), long AS (SELECT year, w, official_error, unnest([" + ", ".join(f"'{k}'" for k in _LONG) + "]) AS feature, unnest([" + ", ".join(_LONG) + "]) AS present FROM f)", "SELECT year, feature, round(sum(w * present) / sum(w), 8) AS prevalence, round(sum(w * present * official_error) / nullif(sum(w * present), 0), 8) AS rate_with, round(sum(w * (1 - present) * official_error) / nullif(sum(w * (1 - present)), 0), 8) AS rate_without FROM long GROUP BY year, feature"))
def prj16d(spark, d):
    """Weighted prevalence of flags by year, and the error rate with and without each."""
    x = built(spark, d).select("year", "w", c("official_error").alias("y"), *_LONG)
    w, y = c("w"), c("y")
    out = []
    sums = [F.sum("w").alias("w"), F.sum(w * y).alias("wy")]
    for k in _LONG:
        sums += [F.sum(w * c(k)).alias(f"{k}_w"), F.sum(w * c(k) * y).alias(f"{k}_wy")]
        out.append(F.struct(F.lit(k).alias("feature"), c(f"{k}_w").alias("on"), c(f"{k}_wy").alias("hit")))
    g = x.groupBy("year").agg(*sums).select("year", "w", "wy", F.inline(F.array(*out)))
    ratio = lambda a, b: F.round(F.try_divide(a, b), 8)
    return g.select("year", "feature", ratio(c("on"), c("w")).alias("prevalence"), ratio(c("hit"), c("on")).alias("rate_with"), ratio(c("wy") - c("hit"), c("w") - c("on")).alias("rate_without"))


def _share(rate: str) -> str:
    return f"avg(({TIER_SQL.format(rate)}) / CAST(100 AS DOUBLE))"


_ELEMENTS = "list_distinct([300 + part % 8, 300 + supp % 8])"
_CUT = f"CASE WHEN err = 0 THEN err ELSE err * (1 - len(list_intersect({_ELEMENTS}, [{ELEMENT}])) / len({_ELEMENTS})) END"
_LEVER = f"""
cells AS (SELECT * REPLACE (grp || '|' || period AS grp), {_CUT} AS cut, err > 0 AND list_contains({_ELEMENTS}, {ELEMENT}) AS touched FROM cases),
pt AS (SELECT grp, count(*) FILTER (WHERE touched) AS touched, sum(weight * (err - cut)) AS dollars, sum(weight * err) * 100 / sum(weight * base) AS p0, sum(weight * cut) * 100 / sum(weight * base) AS p1 FROM cells GROUP BY grp),
smp AS (SELECT grp, weight * err AS we, weight * base AS wb, weight * cut AS ws, row_number() OVER (PARTITION BY grp ORDER BY case_id) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM cells),
sz AS (SELECT DISTINCT grp, n FROM smp),
idx AS (SELECT grp, n, d AS draw, CAST({SEED} AS BIGINT) AS seed, CAST(d * n + j AS BIGINT) AS k FROM sz, range(0, {DRAWS}) t(d), LATERAL (SELECT unnest(range(1, n + 1)) AS j)),{_RNG},
drawn AS (SELECT v.grp, draw, sum(we) * 100 / sum(wb) AS rate, sum(ws) * 100 / sum(wb) AS rate_cut FROM uni v JOIN smp s ON v.grp = s.grp AND s.i = CAST(floor(u * v.n) AS BIGINT) GROUP BY v.grp, draw),
moved AS (SELECT grp, touched, dollars, p1 - p0 AS shift, {OFFICIAL} + (rate - p0) AS now, {OFFICIAL} + (p1 - p0) + (rate_cut - p1) AS adopted, {OFFICIAL} + (rate - p0) + (p0 - p1) AS reversed FROM drawn JOIN pt USING (grp))"""


@query(
    "x06b_accounting_bound",
    with_tables(
        _LEVER,
        f"SELECT grp, max(touched) AS touched, round(max(dollars), 2) AS dollars, round(max(shift), 6) + 0.0 AS shift, round({_share('now')}, 8) AS share_now, round({_share('adopted')}, 8) AS share_adopted, round({_share('reversed')}, 8) AS share_reversed, round({_share('adopted')} - {_share('now')}, 8) + 0.0 AS adopted_delta, round({_share('reversed')} - {_share('now')}, 8) + 0.0 AS reversed_delta FROM moved GROUP BY grp",
    ),
)
def x06b(spark, d):
    """Errors attributed to one element in full: the shift of each cell's rate, expected cost shares over common
    draws with the lever on, and with the shift's sign reversed on the unchanged draws."""
    own = F.array_distinct(F.array(300 + c("part") % 8, 300 + c("supp") % 8).cast("array<int>"))
    w = c("weight")
    rows = cases(spark, d).withColumns({"grp": F.concat_ws("|", "grp", "period"), "cut": S.lever_error(c("err"), own, [ELEMENT], 1.0), "touched": (c("err") > 0) & F.array_contains(own, ELEMENT)})
    points = rows.groupBy("grp").agg(F.count_if("touched").alias("touched"), F.sum(w * (c("err") - c("cut"))).alias("dollars"), R.weighted_ratio("weight", "err", "base").alias("p0"), R.weighted_ratio("weight", "cut", "base").alias("p1"))
    drawn = B.draw_sums(B.samples(rows, "grp", ["case_id"], we=w * c("err"), wb=w * c("base"), ws=w * c("cut")), "grp", DRAWS, SEED, ["we", "wb", "ws"])
    shift = c("p1") - c("p0")
    now = OFFICIAL + (c("we") * 100 / c("wb") - c("p0"))
    rates = {"now": now, "adopted": OFFICIAL + shift + (c("ws") * 100 / c("wb") - c("p1")), "reversed": now - shift}
    share = {k: F.avg(S.tier(r) / 100.0) for k, r in rates.items()}
    g = drawn.join(points, "grp").groupBy("grp").agg(F.max("touched").alias("touched"), F.max("dollars").alias("dollars"), F.max(shift).alias("shift"), *[x.alias(f"share_{k}") for k, x in share.items()])
    delta = {f"{k}_delta": (F.round(c(f"share_{k}") - c("share_now"), 8) + 0.0).alias(f"{k}_delta") for k in ("adopted", "reversed")}
    return g.select("grp", "touched", F.round("dollars", 2).alias("dollars"), (F.round("shift", 6) + 0.0).alias("shift"), *[F.round(f"share_{k}", 8).alias(f"share_{k}") for k in rates], *delta.values())


_DRIFT = f"""
moves AS (SELECT a.grp, round(b.rate - a.rate, 10) AS delta, round(sqrt(100 / a.n + 100 / b.n), 10) AS sd FROM panel a JOIN panel b ON a.grp = b.grp AND a.period = {FROM} AND b.period = {UNTIL}),
smp AS (SELECT delta * delta AS d2, sd * sd AS s2, row_number() OVER (ORDER BY grp) - 1 AS i, count(*) OVER () AS n FROM moves),
idx AS (SELECT n, d AS draw, CAST({SEED} AS BIGINT) AS seed, CAST(d * n + j AS BIGINT) AS k FROM (SELECT DISTINCT n FROM smp), range(0, 400) t(d), LATERAL (SELECT unnest(range(1, n + 1)) AS j)),{_RNG},
taus AS (SELECT draw, sqrt(greatest(CAST(0 AS DOUBLE), round((sum(d2) - sum(s2)) / max(v.n), 10))) AS tau FROM uni v JOIN smp ON smp.i = CAST(floor(u * v.n) AS BIGINT) GROUP BY draw)"""


@query("x26b_drift_bootstrap", with_tables(_DRIFT, "SELECT round((SELECT sqrt(greatest(CAST(0 AS DOUBLE), round((sum(d2) - sum(s2)) / count(*), 10))) FROM smp), 6) AS tau, round(stddev_samp(tau), 6) AS se, round(quantile_cont(tau, 0.025), 6) AS low, round(quantile_cont(tau, 0.975), 6) AS high, round(avg(CASE WHEN tau = 0 THEN 1.0 ELSE 0.0 END), 8) AS zero_share FROM taus"))
def x26b(spark, d):
    """The drift beyond sampling error between two periods, and its bootstrap over jurisdictions: error, interval, share at zero."""
    p = store(panel(spark, d).where(c("period").isin(FROM, UNTIL)).select("grp", "period", "rate", "n"), "panel")
    side = lambda year, k: p.where(c("period") == year).select("grp", c("rate").alias(f"rate{k}"), c("n").alias(f"n{k}"))
    moves = side(FROM, 0).join(side(UNTIL, 1), "grp").select("grp", F.round(c("rate1") - c("rate0"), 10).alias("delta"), F.round(F.sqrt(100 / c("n0") + 100 / c("n1")), 10).alias("sd"))
    moves = M.drift_inputs(moves, "delta", "sd")
    tau = lambda d2, s2, n: F.sqrt(F.greatest(F.lit(0.0), F.round((d2 - s2) / n, 10)))
    squares = {"d2": c("delta") * c("delta"), "s2": c("sd") * c("sd")}
    point = moves.agg(tau(F.sum(squares["d2"]), F.sum(squares["s2"]), F.count("*")).alias("tau"), F.count("*").cast("double").alias("n"))
    whole = moves.withColumn("all", F.lit("all"))
    drawn = B.draw_sums(B.samples(whole, "all", ["grp"], one=F.lit(1.0), **squares), "all", 400, SEED, ["one", "d2", "s2"])
    rates = drawn.select("all", tau(c("d2"), c("s2"), c("one")).alias("rate"))
    s = B.summary(rates, ["all"], "rate")
    return s.crossJoin(point).select(*[F.round(k, 6).alias(k) for k in ("tau", "se", "low", "high")], F.round("zero_share", 8).alias("zero_share"))
