"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import attribution as A
from ..operators import panel as P
from ..operators import rates as R
from ..operators import windows as X
from ..sources.cases import cases, table
from .projections import TIER_SQL
from .registry import panel, query, with_tables

c = F.col
RATE = "round(sum(weight * err) * 100 / sum(weight * base), 6)"


@query("agg01_weighted_ratio", f"SELECT grp, {RATE} AS rate FROM cases GROUP BY grp UNION ALL SELECT 'ALL', {RATE} FROM cases")
def agg01(spark, d):
    return R.with_total(cases(spark, d), "grp", "ALL", F.round(R.weighted_ratio("weight", "err", "base"), 6).alias("rate"))


@query("agg02_weighted_mean", "SELECT period, round(sum(CASE WHEN agency2 IS NOT NULL THEN weight * agency2 END) / sum(CASE WHEN agency2 IS NOT NULL THEN weight END), 8) AS mean FROM cases GROUP BY period")
def agg02(spark, d):
    return cases(spark, d).groupBy("period").agg(F.round(R.weighted_mean(c("agency2").cast("double"), "weight"), 8).alias("mean"))


@query("agg03_effective_n", "SELECT grp, round(sum(weight) * sum(weight) / sum(weight * weight), 6) AS n_eff FROM cases GROUP BY grp")
def agg03(spark, d):
    return cases(spark, d).groupBy("grp").agg(F.round(R.effective_n("weight"), 6).alias("n_eff"))


@query("agg04_prevalence", "SELECT grp, count(*) AS n, round(avg(CASE WHEN err > 0 THEN 1.0 ELSE 0.0 END), 8) AS plain, round(sum(CASE WHEN err > 0 THEN weight ELSE 0 END) / sum(weight), 8) AS weighted, sum(weight) AS weight FROM cases GROUP BY grp")
def agg04(spark, d):
    hit = (c("err") > 0).cast("double")
    return cases(spark, d).groupBy("grp").agg(F.count("*").alias("n"), F.round(F.avg(hit), 8).alias("plain"), F.round(R.weighted_mean(hit, "weight"), 8).alias("weighted"), F.sum("weight").alias("weight"))


_DRAWS = "draws AS (SELECT grp, region, period, rate FROM panel JOIN (SELECT DISTINCT grp, region FROM cases) USING (grp))"


def _draws(spark, d):
    places = cases(spark, d).select("grp", "region").distinct()
    return panel(spark, d).select("grp", "period", "rate").join(places, "grp")


@query(
    "agg05_tier_summary",
    with_tables(
        _DRAWS,
        f"""SELECT region, round(avg(CASE WHEN t = 0 THEN 1.0 ELSE 0.0 END), 8) AS p0, round(avg(CASE WHEN t = 5 THEN 1.0 ELSE 0.0 END), 8) AS p5, round(avg(CASE WHEN t = 10 THEN 1.0 ELSE 0.0 END), 8) AS p10, round(avg(CASE WHEN t = 15 THEN 1.0 ELSE 0.0 END), 8) AS p15,
        round(avg(t / 100.0 * 1000000000), 2) AS mean_bill, round(stddev_pop(t / 100.0 * 1000000000), 2) AS sd_bill, round(quantile_cont(t / CAST(100 AS DOUBLE) * 1000000000, 0.95), 2) AS p95_bill
        FROM (SELECT region, {TIER_SQL.format('rate')} AS t FROM draws) GROUP BY region""",
    ),
)
def agg05(spark, d):
    s = R.draw_summary(_draws(spark, d), ["region"], "rate", F.lit(1e9))
    return s.select("region", *[F.round(f"p{k}", 8).alias(f"p{k}") for k in (0, 5, 10, 15)], *[F.round(n, 2).alias(n) for n in ("mean_bill", "sd_bill", "p95_bill")])


@query(
    "agg06_election",
    with_tables(
        _DRAWS,
        f"""SELECT region, round(avg(CASE WHEN w <= l THEN 1.0 ELSE 0.0 END), 8) AS p_win, round(avg(l), 4) AS lock_bill, round(avg(w), 4) AS wait_bill, round(avg(least(l, w)), 4) AS elect_bill, round(stddev_pop(w), 4) AS wait_sd, round(avg(CASE WHEN later * 1.5 >= 20 THEN 1.0 ELSE 0.0 END), 8) AS p_delay
        FROM (SELECT a.region, b.rate AS later, {TIER_SQL.format('a.rate')} / CAST(100 AS DOUBLE) * 1000000 AS l, {TIER_SQL.format('b.rate')} / CAST(100 AS DOUBLE) * 1000000 AS w FROM draws a JOIN draws b ON a.grp = b.grp AND b.period = a.period + 1) GROUP BY region""",
    ),
)
def agg06(spark, d):
    now = _draws(spark, d)
    later = now.select("grp", (c("period") - 1).alias("period"), c("rate").alias("later"))
    e = R.election(now.join(later, ["grp", "period"]), ["region"], "rate", "later", F.lit(1e6))
    return e.select("region", F.round("p_win", 8).alias("p_win"), *[F.round(n, 4).alias(n) for n in ("lock_bill", "wait_bill", "elect_bill", "wait_sd")], F.round("p_delay", 8).alias("p_delay"))


@query(
    "agg07_panel",
    "SELECT grp, period, count(*) AS n, sum(weight) AS weight, round(sum(weight * base), 2) AS dollars, round(100 * sum(CASE WHEN status = 2 THEN weight * err ELSE 0 END) / sum(weight * base), 6) AS over, round(100 * sum(CASE WHEN status = 3 THEN weight * err ELSE 0 END) / sum(weight * base), 6) AS under FROM cases GROUP BY grp, period",
)
def agg07(spark, d):
    p = P.panel(cases(spark, d), "grp", "period", "weight", "base", {"over": c("status") == 2, "under": c("status") == 3})
    return p.select("grp", "period", "n", "weight", F.round("dollars", 2).alias("dollars"), F.round("over", 6).alias("over"), F.round("under", 6).alias("under"))


@query("agg08_rounded_split", "SELECT grp, round(sum(CASE WHEN status = 2 THEN weight * round(err, 0) ELSE 0 END), 2) AS over, round(sum(CASE WHEN status = 3 THEN weight * round(err, 0) ELSE 0 END), 2) AS under FROM cases GROUP BY grp")
def agg08(spark, d):
    w = c("weight") * F.round("err")
    return cases(spark, d).groupBy("grp").agg(F.round(F.sum(F.when(c("status") == 2, w).otherwise(0.0)), 2).alias("over"), F.round(F.sum(F.when(c("status") == 3, w).otherwise(0.0)), 2).alias("under"))


_RATIO = """ratios AS (SELECT grp, w, wy / w AS observed, wp / w AS predicted, wy / wp AS ratio, greatest((yy - 2 * (wy / wp) * yp + (wy / wp) * (wy / wp) * pp) / (wp * wp), CAST(1e-12 AS DOUBLE)) AS v
FROM (SELECT grp, sum(weight) AS w, sum(weight * err) AS wy, sum(weight * base * CAST(0.05 AS DOUBLE)) AS wp, sum(weight * weight * err * err) AS yy, sum(weight * weight * err * base * CAST(0.05 AS DOUBLE)) AS yp, sum(weight * weight * base * base * CAST(0.05 AS DOUBLE) * CAST(0.05 AS DOUBLE)) AS pp FROM cases GROUP BY grp))"""


def _ratios(spark, d):
    return R.ratio_variance(cases(spark, d).withColumn("guess", c("base") * 0.05), "grp", "weight", "err", "guess")


@query("agg09_ratio_variance", with_tables(_RATIO, "SELECT grp, round(observed, 4) AS observed, round(predicted, 4) AS predicted, round(ratio, 6) AS ratio, round(v, 8) AS variance FROM ratios"))
def agg09(spark, d):
    return _ratios(spark, d).select("grp", F.round("observed", 4).alias("observed"), F.round("predicted", 4).alias("predicted"), F.round("ratio", 6).alias("ratio"), F.round("ratio_variance", 8).alias("variance"))


@query(
    "agg10_calibration",
    "SELECT region, round(regr_slope(err, base * CAST(0.05 AS DOUBLE)), 6) AS slope, round(sum(abs(err - base * CAST(0.05 AS DOUBLE))) / count(*), 4) AS mae, round(corr(err, base), 6) AS corr FROM cases GROUP BY region",
)
def agg10(spark, d):
    rows = cases(spark, d).withColumn("guess", c("base") * 0.05).withColumn("one", F.lit(1.0))
    return R.calibration(rows, ["region"], "guess", "err", "one").select("region", F.round("slope", 6).alias("slope"), F.round("mae", 4).alias("mae"), F.round("corr", 6).alias("corr"))


@query("agg11_shrinkage", with_tables(_RATIO + ", b AS (SELECT greatest(CAST(0 AS DOUBLE), avg((ratio - 1) * (ratio - 1)) - avg(v)) AS t FROM ratios)", "SELECT grp, round(CASE WHEN t > 0 THEN (ratio * t + v) / (t + v) ELSE 1 END, 6) AS factor FROM ratios, b"))
def agg11(spark, d):
    return R.shrink(_ratios(spark, d), "ratio", "ratio_variance").select("grp", F.round("factor", 6).alias("factor"))


@query("agg12_towards_mean", "SELECT grp, round(m + (avg_rate - m) * (CASE WHEN s > 4 THEN (s - 4) / s ELSE 0 END), 6) AS shrunk FROM (SELECT grp, avg(rate) AS avg_rate FROM panel GROUP BY grp), (SELECT avg(x) AS m, var_samp(x) AS s FROM (SELECT avg(rate) AS x FROM panel GROUP BY grp))")
def agg12(spark, d):
    own = panel(spark, d).groupBy("grp").agg(F.avg("rate").alias("x"))
    whole = own.agg(F.avg("x").alias("m"), F.var_samp("x").alias("s"))
    pull = F.when(c("s") > 4, (c("s") - 4) / c("s")).otherwise(0.0)
    return own.crossJoin(F.broadcast(whole)).select("grp", F.round(c("m") + (c("x") - c("m")) * pull, 6).alias("shrunk"))


@query("agg13_metric_block", "SELECT grp, count(*) FILTER (WHERE agency1 = 17) AS hit_n, sum(CASE WHEN agency1 = 17 THEN weight ELSE 0 END) AS hit_weight, round(sum(CASE WHEN agency1 = 17 THEN weight * amount ELSE 0 END), 2) AS hit_dollars, round(sum(CASE WHEN agency1 = 17 THEN weight * amount ELSE 0 END) / sum(weight * amount), 8) AS hit_share FROM cases GROUP BY grp")
def agg13(spark, d):
    g = cases(spark, d).groupBy("grp").agg(*R.metric_block(c("agency1") == 17, "weight", "amount", "hit"))
    return g.select("grp", "hit_n", "hit_weight", F.round("hit_dollars", 2).alias("hit_dollars"), F.round("hit_share", 8).alias("hit_share"))


_CLASS_OF = "CASE WHEN {0} IN (1, 2, 3, 4, 7) THEN 'client_or_fact' WHEN {0} = 8 THEN 'excluded_federal_match' WHEN {0} IN (10, 12) OR {0} BETWEEN 14 AND 25 THEN 'agency_or_system' WHEN {0} = 26 THEN 'no_required_action' WHEN {0} = 99 THEN 'other' END"
_KNOWN = f"list_distinct(list_filter([{_CLASS_OF.format('agency1')}, {_CLASS_OF.format('agency2')}], lambda x: x IS NOT NULL))"
_CLASSED = f"classed AS (SELECT *, CASE WHEN len({_KNOWN}) = 0 THEN ['unclassified'] ELSE {_KNOWN} END AS classes FROM cases)"


def _codes():
    known = F.array(S.documented(c("agency1")), S.documented(c("agency2")))
    return F.array_distinct(F.filter(known, lambda x: x.isNotNull()))


@query("agg14_fractional_causes", with_tables(_CLASSED, "SELECT region, cause, round(sum(weight * err / n), 2) AS dollars FROM (SELECT region, weight, err, len(classes) AS n, unnest(classes) AS cause FROM classed) GROUP BY region, cause"))
def agg14(spark, d):
    return A.fractional(cases(spark, d), ["region"], A.classes(_codes()), "weight", "err").select("region", "cause", F.round("dollars", 2).alias("dollars"))


@query(
    "agg15_exclusive_axis",
    with_tables(_CLASSED, "SELECT CASE WHEN list_contains(classes, 'agency_or_system') AND list_contains(classes, 'client_or_fact') THEN 'mixed' WHEN list_contains(classes, 'agency_or_system') THEN 'agency' WHEN list_contains(classes, 'client_or_fact') THEN 'client' ELSE 'residual' END AS axis, count(*) AS n, round(sum(weight * err), 2) AS dollars FROM classed GROUP BY 1"),
)
def agg15(spark, d):
    return cases(spark, d).groupBy(A.exclusive_axis(A.classes(_codes())).alias("axis")).agg(F.count("*").alias("n"), F.round(F.sum(c("weight") * c("err")), 2).alias("dollars"))


@query("agg16_any_presence", "SELECT region, code, count(*) AS n, round(sum(weight * err), 2) AS dollars FROM (SELECT region, weight, err, unnest(list_distinct(list_filter([agency1, agency2], lambda x: x IS NOT NULL))) AS code FROM cases) GROUP BY region, code")
def agg16(spark, d):
    return A.any_presence(cases(spark, d), ["region"], A.codes("agency1", "agency2"), "code", "weight", "err").select("region", "code", "n", F.round("dollars", 2).alias("dollars"))


@query("agg16b_code_sets", "SELECT grp, " + ", ".join(f"round(sum(CASE WHEN agency1 IN ({s}) OR coalesce(agency2 IN ({s}), FALSE) THEN weight * err ELSE 0 END), 2) AS {n}" for n, s in (("strict", "17, 19, 20"), ("broad", "10, 17, 19, 20, 21, 22"), ("software", "17, 19"))) + " FROM cases GROUP BY grp")
def agg16b(spark, d):
    s = A.code_set_dollars(cases(spark, d), ["grp"], A.codes("agency1", "agency2"), "weight", "err")
    return s.select("grp", *[F.round(n, 2).alias(n) for n in S.CODE_SETS])


@query(
    "agg17_long_slots",
    "SELECT slot, code, count(*) AS n, count(DISTINCT case_id) AS n_cases, round(sum(weight * part), 2) AS dollars FROM (SELECT case_id, weight, CAST(1 AS INTEGER) AS slot, agency1 AS code, amount * 0.75 AS part FROM cases UNION ALL SELECT case_id, weight, 2, agency2, amount * 0.25 FROM cases) WHERE code IS NOT NULL AND part > 0 GROUP BY slot, code",
)
def agg17(spark, d):
    slots = [{"code": c("agency1"), "part": c("amount") * 0.75}, {"code": c("agency2"), "part": c("amount") * 0.25}]
    rows = A.long_slots(cases(spark, d), ["case_id", "weight"], slots).where("code IS NOT NULL AND part > 0")
    return rows.groupBy("slot", "code").agg(F.count("*").alias("n"), F.countDistinct("case_id").alias("n_cases"), F.round(F.sum(c("weight") * c("part")), 2).alias("dollars"))


@query(
    "agg18_nature_classes",
    "SELECT CASE WHEN a AND coalesce(b, a) THEN 'all' WHEN a OR coalesce(b, FALSE) THEN 'some' ELSE 'clear' END AS nature, count(*) AS n FROM (SELECT agency1 > 13 AS a, agency2 > 13 AS b FROM cases) GROUP BY 1",
)
def agg18(spark, d):
    flags = F.transform(F.filter(F.array("agency1", "agency2"), lambda x: x.isNotNull()), lambda x: x > 13)
    return cases(spark, d).groupBy(A.nature(flags).alias("nature")).agg(F.count("*").alias("n"))


@query(
    "agg19_overlap",
    "SELECT region, round(sum(CASE WHEN agency1 > 13 THEN weight * err ELSE 0 END), 2) AS first, round(sum(CASE WHEN agency2 > 13 THEN weight * err ELSE 0 END), 2) AS second, round(sum(CASE WHEN agency1 > 13 OR agency2 > 13 THEN weight * err ELSE 0 END), 2) AS either, round(sum(CASE WHEN agency1 > 13 AND agency2 > 13 THEN weight * err ELSE 0 END), 2) AS twice FROM cases GROUP BY region",
)
def agg19(spark, d):
    o = A.overlap(cases(spark, d), ["region"], {"first": F.coalesce(c("agency1") > 13, F.lit(False)), "second": F.coalesce(c("agency2") > 13, F.lit(False))}, c("weight") * c("err"))
    return o.select("region", F.round("first", 2).alias("first"), F.round("second", 2).alias("second"), F.round("any", 2).alias("either"), F.round("twice", 2).alias("twice"))


@query("agg20_code_mix", "SELECT era, code, n, round(n / CAST(sum(n) OVER (PARTITION BY era) AS DOUBLE), 8) AS share FROM (SELECT CASE WHEN period < 1998 THEN 'early' ELSE 'late' END AS era, agency1 AS code, count(*) AS n FROM cases GROUP BY 1, 2)")
def agg20(spark, d):
    era = F.when(c("period") < 1998, "early").otherwise("late").alias("era")
    n = cases(spark, d).groupBy(era, c("agency1").alias("code")).agg(F.count("*").alias("n"))
    total = n.groupBy("era").agg(F.sum("n").alias("total"))
    return n.join(total, "era").select("era", "code", "n", F.round(c("n") / c("total"), 8).alias("share"))


@query("agg21_value_counts", "SELECT coalesce(CAST(agency2 AS VARCHAR), 'missing') AS value, count(*) AS n FROM cases GROUP BY 1")
def agg21(spark, d):
    return cases(spark, d).groupBy(F.coalesce(c("agency2").cast("string"), F.lit("missing")).alias("value")).agg(F.count("*").alias("n"))


@query(
    "agg22_divergence_catalog",
    "SELECT kind, count(*) AS n, round(median(gap), 8) AS median_gap FROM (SELECT abs(amount - base * 0.1) AS gap, CASE WHEN abs(amount - base * 0.1) < 1 THEN 'rounding' WHEN status = 1 THEN 'settled' WHEN amount > base * 0.1 THEN 'above' ELSE 'below' END AS kind FROM cases) GROUP BY kind",
)
def agg22(spark, d):
    gap = F.abs(c("amount") - c("base") * 0.1)
    kind = F.when(gap < 1, "rounding").when(c("status") == 1, "settled").when(c("amount") > c("base") * 0.1, "above").otherwise("below")
    return cases(spark, d).select(gap.alias("gap"), kind.alias("kind")).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.percentile("gap", F.lit(0.5)), 8).alias("median_gap"))


@query(
    "agg23_parity_table",
    "SELECT grp, count(*) AS n, count(*) FILTER (WHERE round(amount) = round(base * 0.05)) AS exact, min(line) FILTER (WHERE k = best) AS usual_line FROM (SELECT *, max(k) OVER (PARTITION BY grp) AS best FROM (SELECT *, count(*) OVER (PARTITION BY grp, line) AS k FROM cases)) GROUP BY grp",
)
def agg23(spark, d):
    return cases(spark, d).groupBy("grp").agg(F.count("*").alias("n"), F.count_if(F.round("amount") == F.round(c("base") * 0.05)).alias("exact"), F.mode("line", deterministic=True).alias("usual_line"))


@query("agg24_histogram", "SELECT CAST(least(59, greatest(0, floor(discount / 0.1 * 60))) AS INTEGER) AS bin, round(count(*) / CAST((SELECT count(*) FROM cases) AS DOUBLE), 8) AS share FROM cases GROUP BY 1")
def agg24(spark, d):
    return R.histogram(cases(spark, d), "discount", 0.0, 0.1, 60).select("bin", F.round("share", 8).alias("share"))


@query("agg25_national_rollup", "SELECT round(sum(x), 6) AS total, count(*) FILTER (WHERE p >= 0.4) AS likely FROM (SELECT grp, avg(rate) AS x, avg(CASE WHEN rate >= 10 THEN 1.0 ELSE 0.0 END) AS p FROM panel GROUP BY grp)")
def agg25(spark, d):
    g = panel(spark, d).groupBy("grp").agg(F.avg("rate").alias("x"), F.avg((c("rate") >= 10).cast("double")).alias("p"))
    return g.agg(F.round(F.sum("x"), 6).alias("total"), F.count_if(c("p") >= 0.4).alias("likely"))


@query(
    "agg26_did_contrast",
    """WITH cell AS (SELECT c_nationkey % 2 = 0 AS adopter, year(o_orderdate) >= 1998 AS post, sum(l_quantity * l_tax) / sum(l_quantity) AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
    SELECT round(max(x) FILTER (WHERE adopter AND post) - max(x) FILTER (WHERE adopter AND NOT post) - max(x) FILTER (WHERE NOT adopter AND post) + max(x) FILTER (WHERE NOT adopter AND NOT post), 8) + 0.0 AS effect FROM cell""",
)
def agg26(spark, d):
    cell = cases(spark, d).groupBy((c("grp_no") % 2 == 0).alias("a"), (c("period") >= 1998).alias("p")).agg(R.weighted_mean("score", "weight").alias("x"))
    at = lambda a, p: F.max(F.when((c("a") == a) & (c("p") == p), c("x")))
    return cell.agg((F.round(at(True, True) - at(True, False) - at(False, True) + at(False, False), 8) + 0.0).alias("effect"))


@query("agg27_cross_section", "SELECT period, status = 2 AS over, count(*) AS n, round(avg(amount), 4) AS mean FROM cases GROUP BY 1, 2")
def agg27(spark, d):
    return cases(spark, d).groupBy("period", (c("status") == 2).alias("over")).agg(F.count("*").alias("n"), F.round(F.avg("amount"), 4).alias("mean"))


@query(
    "agg27b_rates_by_denominator",
    """SELECT denominator, required, count(*) AS n, round(sum(weight * CASE WHEN err > 0 THEN 1 ELSE 0 END) / sum(weight), 8) AS rate, round(sum(weight * err) / sum(weight * base), 8) AS dollars FROM (
      SELECT *, unnest(CASE WHEN agency2 > 0 THEN ['all', 'claimants'] ELSE ['all'] END) AS denominator, base / 1000 > 35 AS required FROM cases WHERE supp % 3 = 0) GROUP BY denominator, required""",
)
def agg27b(spark, d):
    """Rates by whether documentation is required, over claimants and over the stable denominator: one pass, a case in each it belongs to."""
    group = cases(spark, d).where("supp % 3 = 0").withColumn("required", c("base") / 1000 > 35)
    both = group.withColumn("denominator", F.explode(F.when(c("agency2") > 0, F.array(F.lit("all"), F.lit("claimants"))).otherwise(F.array(F.lit("all")))))
    w = c("weight")
    return both.groupBy("denominator", "required").agg(F.count("*").alias("n"), F.round(R.weighted_mean((c("err") > 0).cast("double"), "weight"), 8).alias("rate"), F.round(F.sum(w * c("err")) / F.sum(w * c("base")), 8).alias("dollars"))


@query(
    "agg27c_yearly_cadence",
    """SELECT period, count(*) AS n, count(*) FILTER (WHERE agency2 IS NULL) AS missing, count(*) FILTER (WHERE agency2 > line * 3) AS inconsistent, count(*) FILTER (WHERE agency2 BETWEEN 1 AND 2) AS near,
      round(sum(weight * CASE WHEN agency2 BETWEEN 1 AND 2 THEN 1 ELSE 0 END) / sum(weight), 8) AS near_rate, count(*) FILTER (WHERE agency2 > 0) AS valid,
      round(count(*) FILTER (WHERE agency2 >= 24) / CAST(count(*) FILTER (WHERE agency2 > 0) AS DOUBLE), 8) AS long_share, round(count(*) FILTER (WHERE agency2 >= 24 AND supp % 3 = 0) / CAST(count(*) FILTER (WHERE agency2 > 0 AND supp % 3 = 0) AS DOUBLE), 8) AS long_share_group
    FROM cases GROUP BY ROLLUP (period)""",
)
def agg27c(spark, d):
    """Coverage and cadence of a feature family by year and over all years, from one rollup; shares are of cases with a valid period."""
    x, group = c("agency2"), c("supp") % 3 == 0
    near = F.coalesce(x.between(1, 2), F.lit(False))
    share = lambda on: F.round(F.try_divide(F.count_if((x >= 24) & on), F.count_if((x > 0) & on)), 8)
    return cases(spark, d).rollup("period").agg(
        F.count("*").alias("n"), F.count_if(x.isNull()).alias("missing"), F.count_if(x > c("line") * 3).alias("inconsistent"), F.count_if(near).alias("near"),
        F.round(R.weighted_mean(near.cast("double"), "weight"), 8).alias("near_rate"), F.count_if(x > 0).alias("valid"), share(F.lit(True)).alias("long_share"), share(group).alias("long_share_group"),
    )


@query(
    "agg27d_registry_cross_check",
    with_tables(
        "registry AS (SELECT n_name AS grp, p AS period, CASE WHEN (n_nationkey + p) % 5 > 0 THEN CAST((n_nationkey + p) % 2 AS INTEGER) END AS status_known FROM nation, range(1995, 2001) t(p))",
        """SELECT c.period, status_known AS registered, count(*) AS n, count(*) FILTER (WHERE agency2 IS NULL) AS code_missing, count(*) FILTER (WHERE agency2 IN (2, 3)) AS pattern,
          round(sum(weight * CASE WHEN agency2 IN (2, 3) THEN 1 ELSE 0 END) / sum(weight), 8) AS pattern_rate, r.grp IS NULL AS unlisted
        FROM cases c LEFT JOIN registry r ON c.grp = r.grp AND c.period = r.period GROUP BY c.period, status_known, unlisted""",
    ),
)
def agg27d(spark, d):
    """Cases' code patterns beside the registered status of their place and year; places that aren't listed or have no status are counted apart."""
    years = F.explode(F.sequence(F.lit(1995), F.lit(2000))).alias("period")
    place = table(spark, d, "nation").select(c("n_name").alias("grp"), "n_nationkey", years)
    status = F.when((c("n_nationkey") + c("period")) % 5 > 0, ((c("n_nationkey") + c("period")) % 2).cast("int"))
    registry = place.select("grp", "period", status.alias("registered"), F.lit(True).alias("listed"))
    hit = F.coalesce(c("agency2").isin(2, 3), F.lit(False))
    rows = cases(spark, d).join(registry, ["grp", "period"], "left").withColumn("unlisted", c("listed").isNull())
    out = rows.groupBy("period", "registered", "unlisted").agg(F.count("*").alias("n"), F.count_if(c("agency2").isNull()).alias("code_missing"), F.count_if(hit).alias("pattern"), F.round(R.weighted_mean(hit.cast("double"), "weight"), 8).alias("pattern_rate"))
    return out.select("period", "registered", "n", "code_missing", "pattern", "pattern_rate", "unlisted")


@query("agg28_band_coverage", "SELECT period, count(*) FILTER (WHERE abs(base / 1000 - 45) <= 1) AS near, count(*) FILTER (WHERE abs(base / 1000 - 45) <= 5) AS wide, count(*) FILTER (WHERE abs(base / 1000 - 45) <= 5 AND err > 0) AS overlap FROM cases GROUP BY period")
def agg28(spark, d):
    away = F.abs(c("base") / 1000 - 45)
    return cases(spark, d).groupBy("period").agg(F.count_if(away <= 1).alias("near"), F.count_if(away <= 5).alias("wide"), F.count_if((away <= 5) & (c("err") > 0)).alias("overlap"))


@query("agg29_robust_drift", "SELECT round(avg(rate), 6) AS mean, round(var_samp(rate), 6) AS variance, round(median(rate), 6) AS median, round(mad(rate) / 0.67449, 6) AS mad_sd FROM panel")
def agg29(spark, d):
    return R.robust_spread(panel(spark, d), "rate").select(*[F.round(n, 6).alias(n) for n in ("mean", "variance", "median", "mad_sd")])


@query("agg30_flips", f"SELECT a.period, count(*) FILTER (WHERE {TIER_SQL.format('a.rate')} <> {TIER_SQL.format('b.rate')}) AS flips, round(median(b.rate - a.rate), 6) + 0.0 AS median_move FROM panel a JOIN panel b ON a.grp = b.grp AND b.period = a.period + 1 GROUP BY a.period")
def agg30(spark, d):
    p = panel(spark, d)
    later = p.select("grp", (c("period") - 1).alias("period"), c("rate").alias("later"))
    j = p.join(later, ["grp", "period"])
    return j.groupBy("period").agg(F.count_if(S.tier(c("rate")) != S.tier(c("later"))).alias("flips"), (F.round(F.percentile(c("later") - c("rate"), F.lit(0.5)), 6) + 0.0).alias("median_move"))


@query("agg31_concordance", "SELECT round(avg(CASE WHEN abs(amount - base * score) <= 1e-9 THEN 1.0 ELSE 0.0 END), 8) AS share, round(sum(CASE WHEN abs(amount - base * score) <= 1e-9 THEN weight ELSE 0 END) / sum(weight), 8) AS weighted FROM cases")
def agg31(spark, d):
    same = (F.abs(c("amount") - c("base") * c("score")) <= 1e-9).cast("double")
    return cases(spark, d).agg(F.round(F.avg(same), 8).alias("share"), F.round(R.weighted_mean(same, "weight"), 8).alias("weighted"))


@query("agg32_population_summary", "SELECT grp, count(*) FILTER (WHERE deviation <> 0) AS deviators, round(avg(abs(deviation)) FILTER (WHERE deviation <> 0), 4) AS mean_size FROM cases GROUP BY grp")
def agg32(spark, d):
    return cases(spark, d).groupBy("grp").agg(F.count_if(c("deviation") != 0).alias("deviators"), F.round(F.avg(F.when(c("deviation") != 0, F.abs("deviation"))), 4).alias("mean_size"))


@query("agg33_cap_diagnostics", "SELECT grp, count(*) FILTER (WHERE abs(deviation) > base * 0.1) AS clipped, round(sum(greatest(abs(deviation) - base * 0.1, CAST(0 AS DOUBLE))), 2) AS mass FROM cases GROUP BY grp")
def agg33(spark, d):
    over = F.abs("deviation") - c("base") * 0.1
    return cases(spark, d).groupBy("grp").agg(F.count_if(F.abs("deviation") > c("base") * 0.1).alias("clipped"), F.round(F.sum(F.greatest(over, F.lit(0.0))), 2).alias("mass"))


@query("agg34_household", "SELECT orderkey, count(*) AS size, sum(weight) AS weight, max(line) AS last, bool_or(status = 2) AS any_over FROM cases GROUP BY orderkey")
def agg34(spark, d):
    return cases(spark, d).groupBy("orderkey").agg(F.count("*").alias("size"), F.sum("weight").alias("weight"), F.max("line").alias("last"), F.bool_or(c("status") == 2).alias("any_over"))


@query("agg36_conditional_sums", "SELECT region, " + ", ".join(f"sum(CASE WHEN line = {i} THEN weight ELSE 0 END) AS w{i}" for i in range(1, 8)) + " FROM cases GROUP BY region")
def agg36(spark, d):
    return cases(spark, d).groupBy("region").agg(*[F.sum(F.when(c("line") == i, c("weight")).otherwise(0.0)).alias(f"w{i}") for i in range(1, 8)])


@query("agg37_moved_denominator", "SELECT grp, round(sum(weight * err) * 100 / sum(weight * base), 6) AS rate, round(sum(weight * err) * 100 / sum(weight * base * CAST(1.05 AS DOUBLE)), 6) AS moved FROM cases GROUP BY grp")
def agg37(spark, d):
    return cases(spark, d).groupBy("grp").agg(F.round(R.weighted_ratio("weight", "err", "base"), 6).alias("rate"), F.round(R.weighted_ratio("weight", "err", c("base") * 1.05), 6).alias("moved"))


_DEMEANED = "dm AS (SELECT grp, period, rate - avg(rate) OVER (PARTITION BY period) AS x FROM panel)"


@query("agg38_lag_products", with_tables(_DEMEANED, "SELECT b.period - a.period AS lag, count(*) AS n, round(avg(a.x * b.x), 6) + 0.0 AS product FROM dm a JOIN dm b ON a.grp = b.grp AND b.period >= a.period AND b.period - a.period <= 3 GROUP BY 1"))
def agg38(spark, d):
    x = P.demeaned(panel(spark, d), "period", "rate", "x")
    return P.lag_products(x, "grp", "period", "x", [0, 1, 2, 3]).select("lag", "n", (F.round("product", 6) + 0.0).alias("product"))


_GAPS = "gaps AS (SELECT a.grp AS unit, a.period, a.rate - b.m AS gap FROM panel a JOIN (SELECT period, avg(rate) AS m FROM panel GROUP BY period) b USING (period))"


@query("agg39_gap_effects", with_tables(_GAPS, "SELECT unit, round(sqrt(avg(gap * gap) FILTER (WHERE period < 1998)), 6) AS rmspe, round(avg(gap) FILTER (WHERE period < 1998), 6) + 0.0 AS pre_gap, round(avg(gap) FILTER (WHERE period BETWEEN 1998 AND 2000), 6) + 0.0 AS post_gap FROM gaps GROUP BY unit"))
def agg39(spark, d):
    gaps = P.demeaned(panel(spark, d), "period", "rate", "gap").select(c("grp").alias("unit"), "period", F.lit("rate").alias("outcome"), "gap")
    e = P.gap_effects(gaps, [1995, 1996, 1997], [1998, 1999, 2000])
    return e.select("unit", F.round("rmspe", 6).alias("rmspe"), (F.round("pre_gap", 6) + 0.0).alias("pre_gap"), (F.round("post_gap", 6) + 0.0).alias("post_gap"))


@query("agg40_wedge", "SELECT grp, period, round(grp_no % 9 - rate, 6) + 0.0 AS wedge FROM panel")
def agg40(spark, d):
    return panel(spark, d).select("grp", "period", (F.round(c("grp_no") % 9 - c("rate"), 6) + 0.0).alias("wedge"))


_PIT = """pit AS (SELECT region, score * 10 AS u, sum(weight) AS w FROM cases GROUP BY region, score * 10),
pit2 AS (SELECT *, sum(w) OVER (PARTITION BY region) AS total, (sum(w) OVER (PARTITION BY region ORDER BY u ROWS UNBOUNDED PRECEDING) - w) / sum(w) OVER (PARTITION BY region) AS below, coalesce(lag(u) OVER (PARTITION BY region ORDER BY u), CAST(0 AS DOUBLE)) AS lft, max(u) OVER (PARTITION BY region) AS top FROM pit)"""


@query("agg41_weighted_pit", with_tables(_PIT, "SELECT region, round(sum(w * u) / max(total), 6) AS mean, round(sum((pow(u - below, 3) - pow(lft - below, 3)) / 3) + max((pow(1 - 1.0, 3) - pow(top - 1, 3)) / 3), 6) AS cvm FROM pit2 GROUP BY region"))
def agg41(spark, d):
    x = X.weighted_pit(cases(spark, d).withColumn("u", c("score") * 10), ["region"], "u", "weight")
    return x.select("region", F.round("mean", 6).alias("mean"), F.round("cvm", 6).alias("cvm"))


@query("x11_capture_rollup", "SELECT coalesce(region, 'ALL') AS region, coalesce(grp, 'ALL') AS grp, round(sum(weight * err), 2) AS dollars FROM cases GROUP BY ROLLUP (region, grp)")
def x11(spark, d):
    r = cases(spark, d).rollup("region", "grp").agg(F.sum(c("weight") * c("err")).alias("x"))
    return r.select(F.coalesce("region", F.lit("ALL")).alias("region"), F.coalesce("grp", F.lit("ALL")).alias("grp"), F.round("x", 2).alias("dollars"))


@query("x02_by_supplier", "SELECT s_name, count(*) AS n, round(sum(weight * err) * 100 / sum(weight * base), 6) AS rate FROM cases JOIN supplier ON supp = s_suppkey GROUP BY s_name")
def x02(spark, d):
    s = table(spark, d, "supplier").select(c("s_suppkey").alias("supp"), "s_name")
    return cases(spark, d).join(s, "supp").groupBy("s_name").agg(F.count("*").alias("n"), F.round(R.weighted_ratio("weight", "err", "base"), 6).alias("rate"))
