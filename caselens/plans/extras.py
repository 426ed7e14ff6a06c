"""Remaining operators of the inventory: payloads, scenarios, refits, gates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import quantiles as Q
from ..functions import rng
from ..functions import scalars as S
from ..operators import attribution as A
from ..operators import rates as R
from ..operators import windows as X
from ..sources import writers
from ..sources.cases import cases, table
from .ordered import _Q, _QUANTILES, _quantiles, _survival_sql
from .projections import TIER_SQL
from .registry import panel, query, with_tables
from .simulation import _RNG, _SAMPLE, _drawn

c = F.col


@query("src12_three_levels", "SELECT c_mktsegment, count(DISTINCT c_custkey) AS households, count(DISTINCT o_orderkey) AS units, count(*) AS people FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_mktsegment")
def src12(spark, d):
    people = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("k"))
    units = table(spark, d, "orders").join(people, c("o_orderkey") == c("l_orderkey")).groupBy("o_custkey").agg(F.count("*").alias("units"), F.sum("k").alias("people"))
    homes = table(spark, d, "customer").join(units, c("c_custkey") == c("o_custkey"))
    return homes.groupBy("c_mktsegment").agg(F.count("*").alias("households"), F.sum("units").alias("units"), F.sum("people").alias("people"))


@query("src13_parquet_scan", "SELECT s_name, s_nationkey FROM supplier")
def src13(spark, d):
    return table(spark, d, "supplier").select("s_name", "s_nationkey")


@query("jn07_row_aligned", "SELECT case_id, weight * 2 AS a, base / 2 AS b FROM cases")
def jn07(spark, d):
    rows = cases(spark, d)
    return rows.select("case_id", (c("weight") * 2).alias("a")).join(rows.select("case_id", (c("base") / 2).alias("b")), "case_id")


@query("jn23_patch_replaces", "SELECT case_id, CASE WHEN line = 6 AND status = 2 THEN CAST(0 AS DOUBLE) ELSE score END AS score FROM cases")
def jn23(spark, d):
    rows = cases(spark, d)
    patch = rows.where("line = 6 AND status = 2").select("case_id", F.lit(0.0).alias("score"))
    return writers.apply_patch(rows.select("case_id", "score"), patch, ["case_id"], "score")


@query("agg35_claim_shares", "SELECT a, b, count(*) AS n, round(sum(weight) / (SELECT sum(weight) FROM cases), 8) AS share FROM (SELECT agency1 > 13 AS a, coalesce(agency2 > 13, FALSE) AS b, weight FROM cases) GROUP BY a, b")
def agg35(spark, d):
    rows = cases(spark, d).select((c("agency1") > 13).alias("a"), F.coalesce(c("agency2") > 13, F.lit(False)).alias("b"), "weight")
    whole = rows.agg(F.sum("weight").alias("all"))
    return rows.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).crossJoin(F.broadcast(whole)).select("a", "b", "n", F.round(c("w") / c("all"), 8).alias("share"))


_PAIRS = "pairs AS (SELECT row_number() OVER (ORDER BY a.grp) - 1 AS i, a.rate AS x, b.rate AS y FROM panel a JOIN panel b ON a.grp = b.grp AND a.period = 1996 AND b.period = 2000), cnt AS (SELECT count(*) AS n FROM pairs)"


@query(
    "bst05_group_refit",
    with_tables(
        _PAIRS + ", idx AS (SELECT d AS draw, n, CAST(5 AS BIGINT) AS seed, CAST(d * n + j AS BIGINT) AS k FROM cnt, range(0, 30) t(d), LATERAL (SELECT unnest(range(1, n + 1)) AS j))," + _RNG,
        "SELECT CAST(draw AS INTEGER) AS draw, round((count(*) * sum(x.x * x.y) - sum(x.x) * sum(x.y)) / (count(*) * sum(x.x * x.x) - sum(x.x) * sum(x.x)), 6) + 0.0 AS slope FROM uni JOIN pairs x ON x.i = floor(u * n) GROUP BY draw",
    ),
)
def bst05(spark, d):
    p = panel(spark, d)
    pairs = p.where("period = 1996").select("grp", c("rate").alias("x")).join(p.where("period = 2000").select("grp", c("rate").alias("y")), "grp")
    # A row per group: the array is as long as there are groups.
    rows = pairs.agg(F.sort_array(F.collect_list(F.struct("grp", "x", "y"))).alias("rows")).withColumn("n", F.size("rows"))
    each = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(29)))).withColumn("j", F.explode(F.sequence(F.lit(1), c("n"))))
    u = rng.uniform(F.lit(5).cast("long"), c("draw").cast("long") * c("n") + c("j"))
    r = F.get("rows", F.floor(u * c("n")).cast("int"))
    picks = each.select("draw", r.alias("r")).select("draw", "r.x", "r.y")
    n, x, y = F.count("*"), c("x"), c("y")
    slope = (n * F.sum(x * y) - F.sum(x) * F.sum(y)) / (n * F.sum(x * x) - F.sum(x) * F.sum(x))
    return picks.groupBy("draw").agg((F.round(slope, 6) + 0.0).alias("slope"))


@query(
    "bst10_exposure_path",
    with_tables(
        "idx AS (SELECT CAST(d AS INTEGER) AS draw, CAST(19 AS BIGINT) AS seed, CAST(6 * d + t + 1 AS BIGINT) AS k, t FROM range(0, 50) x(d), range(0, 6) y(t))," + _RNG
        + ", zs AS (SELECT draw, " + ", ".join(f"sqrt(-2 * ln(greatest(max(u) FILTER (WHERE t = {2 * i}), CAST(1e-12 AS DOUBLE)))) * cos(2 * CAST(3.141592653589793 AS DOUBLE) * max(u) FILTER (WHERE t = {2 * i + 1})) AS z{i}" for i in range(3)) + " FROM uni GROUP BY draw), "
        "pth AS (SELECT grp, draw, 10 + (m - 10) * CAST(0.7 AS DOUBLE) + z0 AS r1, 10 + ((m - 10) * CAST(0.7 AS DOUBLE) + z0) * CAST(0.7 AS DOUBLE) + z1 AS r2, 10 + (((m - 10) * CAST(0.7 AS DOUBLE) + z0) * CAST(0.7 AS DOUBLE) + z1) * CAST(0.7 AS DOUBLE) + z2 AS r3 FROM (SELECT grp, avg(rate) AS m FROM panel GROUP BY grp), zs)",
        f"SELECT grp, round(avg({TIER_SQL.format('r1')} + {TIER_SQL.format('r2')} + {TIER_SQL.format('r3')}), 6) AS mean_tiers FROM pth GROUP BY grp",
    ),
)
def bst10(spark, d):
    seed = F.lit(19).cast("long")
    u = lambda t: rng.uniform(seed, 6 * c("id") + t + 1)
    draws = spark.range(50).select("id", *[S.normal_of(u(2 * i), u(2 * i + 1)).alias(f"z{i}") for i in range(3)])
    state = panel(spark, d).groupBy("grp").agg(F.avg("rate").alias("m")).crossJoin(F.broadcast(draws))
    away, total = c("m") - 10, F.lit(0)
    for i in range(3):
        away = away * 0.7 + c(f"z{i}")
        total = total + S.tier(10 + away)
    return state.groupBy("grp").agg(F.round(F.avg(total), 6).alias("mean_tiers"))


@query(
    "win12_simplex",
    with_tables(
        "v AS (SELECT period, grp, rate / 10 AS x FROM panel), o AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY x DESC, grp) AS k, sum(x) OVER (PARTITION BY period ORDER BY x DESC, grp ROWS UNBOUNDED PRECEDING) AS s FROM v), r AS (SELECT period, max(k) AS k FROM o WHERE x > (s - 1) / k GROUP BY period), t AS (SELECT o.period, (o.s - 1) / o.k AS theta FROM o JOIN r ON o.period = r.period AND o.k = r.k)",
        "SELECT v.period, grp, round(greatest(x - theta, CAST(0 AS DOUBLE)), 8) AS part FROM v JOIN t USING (period)",
    ),
)
def win12(spark, d):
    v = panel(spark, d).select("period", "grp", (c("rate") / 10).alias("x"))
    down = W.partitionBy("period").orderBy(F.desc("x"), "grp")
    o = v.withColumn("k", F.row_number().over(down)).withColumn("s", F.sum("x").over(down.rowsBetween(W.unboundedPreceding, 0)))
    theta = o.where(c("x") > (c("s") - 1) / c("k")).groupBy("period").agg(F.max_by((c("s") - 1) / c("k"), "k").alias("theta"))
    return v.join(theta, "period").select("period", "grp", F.round(F.greatest(c("x") - c("theta"), F.lit(0.0)), 8).alias("part"))


@query("srt02_multi_key", "SELECT grp, case_id FROM cases ORDER BY score DESC, grp, case_id")
def srt02(spark, d):
    return cases(spark, d).orderBy(F.desc("score"), "grp", "case_id").select("grp", "case_id")


@query("srt06_sort_by_expression", "SELECT grp, round(max(rate) - min(rate), 6) AS spread FROM panel GROUP BY grp ORDER BY spread DESC, grp")
def srt06(spark, d):
    return panel(spark, d).groupBy("grp").agg(F.round(F.max("rate") - F.min("rate"), 6).alias("spread")).orderBy(F.desc("spread"), "grp")


@query("set04_ordered_distinct", "SELECT orderkey, list(part ORDER BY k) AS parts FROM (SELECT orderkey, part, min(case_id) AS k FROM cases GROUP BY orderkey, part) GROUP BY orderkey")
def set04(spark, d):
    rows = cases(spark, d).groupBy("orderkey", "part").agg(F.min("case_id").alias("case_id")).groupBy("orderkey").agg(F.sort_array(F.collect_list(F.struct("case_id", "part"))).alias("r"))
    return rows.select("orderkey", F.array_distinct("r.part").alias("parts"))


@query("qnt11_variance_gates", "SELECT grp, round(avg(score) * 10, 6) AS tail, avg(score) * 10 < 0.45 AND avg(score) * 10 + 1.96 * stddev_samp(score) * 10 / sqrt(count(*)) < 0.5 AS passes FROM cases GROUP BY grp")
def qnt11(spark, d):
    tail, se = F.avg("score") * 10, F.stddev_samp("score") * 10 / F.sqrt(F.count("*"))
    return cases(spark, d).groupBy("grp").agg(F.round(tail, 6).alias("tail"), ((tail < 0.45) & (tail + 1.96 * se < 0.5)).alias("passes"))


@query("qnt12_policy_flip", "SELECT grp, count(*) FILTER (WHERE base > 30000 AND grp_no % 2 = 0) AS documented, count(*) FILTER (WHERE base > 30000 AND NOT grp_no % 2 = 0) AS flipped FROM cases GROUP BY grp")
def qnt12(spark, d):
    above, policy = c("base") > 30000, c("grp_no") % 2 == 0
    return cases(spark, d).groupBy("grp").agg(F.count_if(above & policy).alias("documented"), F.count_if(above & ~policy).alias("flipped"))


@query("ml05_tail_fit", with_tables(_QUANTILES, "SELECT grp, round(sum(weight * (ln(amount) - ln(value))) / sum(weight), 6) AS tail FROM cases JOIN quant USING (grp) WHERE level = 0.9 AND amount > value GROUP BY grp"))
def ml05(spark, d):
    rows = cases(spark, d).where("amount > 0")
    cut = X.weighted_quantiles(cases(spark, d), ["grp"], "amount", "weight", [0.9]).drop("level")
    over = rows.join(cut, "grp").where("amount > value").withColumn("e", F.ln("amount") - F.ln("value"))
    return over.groupBy("grp").agg(F.round(R.weighted_mean("e", "weight"), 6).alias("tail"))


@query("x01_process_prediction", with_tables(_Q, f"SELECT case_id, round(0.4 * {_survival_sql('ln(CAST(500 AS DOUBLE))')}, 8) AS crosses, round(q[5] + ln(CAST(1.1 AS DOUBLE)), 8) AS median FROM q"))
def x01(spark, d):
    p = 0.4 * Q.survival(F.lit(500.0), c("q"), F.lit(0.4))
    return _quantiles(spark, d).select("case_id", F.round(p, 8).alias("crosses"), F.round(F.get("q", F.lit(4)) + F.ln(F.lit(1.1)), 8).alias("median"))


@query("x03_decoded_payload", "SELECT orderkey // 64 AS chunk, case_id, CAST(weight AS BIGINT) AS w, status FROM cases")
def x03(spark, d):
    # A payload holds 64 keys in a row: its arrays keep their size in tables of any size.
    rows = cases(spark, d).withColumn("chunk", F.expr("orderkey div 64"))
    packed = writers.struct_of_arrays(rows, "chunk", ["case_id"], id=c("case_id"), w=c("weight").cast("long"), status=c("status"))
    text = packed.select("chunk", F.to_json(F.struct("id", "w", "status")).alias("body"))
    back = text.select("chunk", F.from_json("body", "id ARRAY<STRING>, w ARRAY<BIGINT>, status ARRAY<INT>", {"mode": "FAILFAST"}).alias("b"))
    return back.select("chunk", F.inline(F.arrays_zip("b.id", "b.w", "b.status"))).withColumnRenamed("id", "case_id")


_EL = "list_distinct([300 + part % 8, 300 + supp % 8])"


@query("x06_reversed_bound", f"SELECT grp, round(2 * sum(weight * err) * 100 / sum(weight * base) - sum(weight * CASE WHEN err = 0 THEN err ELSE err * (1 - len(list_intersect({_EL}, [305])) / len({_EL})) END) * 100 / sum(weight * base), 6) AS bound FROM cases GROUP BY grp")
def x06(spark, d):
    elements = F.array_distinct(F.array(300 + c("part") % 8, 300 + c("supp") % 8))
    cut = S.lever_error(c("err"), elements.cast("array<int>"), [305], 1.0)
    base = R.weighted_ratio("weight", "err", "base")
    return cases(spark, d).groupBy("grp").agg(F.round(2 * base - R.weighted_ratio("weight", cut, "base"), 6).alias("bound"))


@query("x07_scenario_totals", "SELECT scenario, count(*) FILTER (WHERE changed <> err) AS changed, round(sum(weight * (changed - err)), 2) + 0.0 AS delta FROM (SELECT weight, err, unnest(['half', 'none', 'over']) AS scenario, unnest([err * 0.5, err, CASE WHEN status = 2 THEN CAST(0 AS DOUBLE) ELSE err END]) AS changed FROM cases) GROUP BY scenario")
def x07(spark, d):
    e = c("err")
    runs = F.array(*[F.struct(F.lit(n).alias("scenario"), x.alias("changed")) for n, x in (("half", e * 0.5), ("none", e), ("over", F.when(c("status") == 2, 0.0).otherwise(e)))])
    rows = cases(spark, d).select("weight", "err", F.inline(runs))
    return rows.groupBy("scenario").agg(F.count_if(c("changed") != e).alias("changed"), (F.round(F.sum(c("weight") * (c("changed") - e)), 2) + 0.0).alias("delta"))


@query("x09_consequence_window", "SELECT grp, round(avg(rate) FILTER (WHERE period BETWEEN 1995 AND 1997) - avg(rate) FILTER (WHERE period > 1997), 6) + 0.0 AS profile FROM panel GROUP BY grp")
def x09(spark, d):
    early = c("period").between(1995, 1997)
    return panel(spark, d).groupBy("grp").agg((F.round(F.avg(F.when(early, c("rate"))) - F.avg(F.when(c("period") > 1997, c("rate"))), 6) + 0.0).alias("profile"))


@query("x10_channel_verdicts", "SELECT grp, CASE WHEN x > 2 * y THEN 'over leads' WHEN y > 2 * x THEN 'under leads' ELSE 'even' END AS verdict FROM (SELECT grp, sum(CASE WHEN status = 2 THEN weight * err ELSE 0 END) AS x, sum(CASE WHEN status = 3 THEN weight * err ELSE 0 END) AS y FROM cases GROUP BY grp)")
def x10(spark, d):
    side = lambda s: F.sum(F.when(c("status") == s, c("weight") * c("err")).otherwise(0.0))
    g = cases(spark, d).groupBy("grp").agg(side(2).alias("x"), side(3).alias("y"))
    return g.select("grp", F.when(c("x") > 2 * c("y"), "over leads").when(c("y") > 2 * c("x"), "under leads").otherwise("even").alias("verdict"))


@query("x12_rate_panel_wide", "SELECT grp, " + ", ".join(f"max(rate) FILTER (WHERE period = {y}) AS r{y}" for y in range(1995, 2002)) + " FROM panel GROUP BY grp")
def x12(spark, d):
    wide = panel(spark, d).groupBy("grp").pivot("period", list(range(1995, 2002))).agg(F.max("rate"))
    return wide.select("grp", *[c(f"`{y}`").alias(f"r{y}") for y in range(1995, 2002)])


@query("x13_variant_quantiles", with_tables(_SAMPLE, "SELECT grp, round(avg(rate), 6) AS mean, round(quantile_cont(rate, 0.05), 6) AS q05, round(quantile_cont(rate, 0.5), 6) AS q50, round(quantile_cont(rate, 0.95), 6) AS q95, count(*) FILTER (WHERE rate < 10) AS below FROM drawn GROUP BY grp"))
def x13(spark, d):
    q = F.percentile("rate", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    g = _drawn(spark, d).groupBy("grp").agg(F.avg("rate").alias("m"), q.alias("q"), F.count_if(c("rate") < 10).alias("below"))
    return g.select("grp", F.round("m", 6).alias("mean"), *[F.round(F.get("q", F.lit(i)), 6).alias(n) for i, n in enumerate(("q05", "q50", "q95"))], "below")


@query("x18_composite_key", "SELECT CASE WHEN base < 20000 THEN 'b0' ELSE 'b1' END || '|' || CASE WHEN weight < 25 THEN 'w0' ELSE 'w1' END || '|' || CAST(line AS VARCHAR) AS cell, count(*) AS n FROM cases GROUP BY 1")
def x18(spark, d):
    cell = F.concat_ws("|", S.band(c("base"), [20000], ["b0", "b1"]), S.band(c("weight"), [25], ["w0", "w1"]), c("line").cast("string"))
    return cases(spark, d).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))


@query("x19_agency_findings", "SELECT case_id, CAST(len(cs) AS INTEGER) AS n, CAST(len(list_intersect(cs, [17, 19, 20])) AS INTEGER) AS strict FROM (SELECT case_id, list_distinct(list_filter([agency1, agency2], lambda x: x IS NOT NULL)) AS cs FROM cases)")
def x19(spark, d):
    codes = A.codes("agency1", "agency2")
    return cases(spark, d).select("case_id", F.size(codes).alias("n"), F.size(F.filter(codes, lambda x: x.isin(*S.CODE_SETS["strict"]))).alias("strict"))


@query("x23_plausible_caseload", "SELECT period, sum(weight) AS caseload, sum(weight) BETWEEN 1000 AND 100000000 AS plausible, count(*) FILTER (WHERE agency2 IS NULL) AS gaps FROM cases GROUP BY period")
def x23(spark, d):
    w = F.sum("weight")
    return cases(spark, d).groupBy("period").agg(w.alias("caseload"), w.between(1000, 100_000_000).alias("plausible"), F.count_if(c("agency2").isNull()).alias("gaps"))


@query("x25_bracket_deltas", "SELECT case_id, round(base * 0.06 - base * 0.05, 8) AS upper, round(base * 0.05 - base * 0.045, 8) AS lower FROM cases")
def x25(spark, d):
    b = c("base")
    return cases(spark, d).select("case_id", F.round(b * 0.06 - b * 0.05, 8).alias("upper"), F.round(b * 0.05 - b * 0.045, 8).alias("lower"))


@query("x26_bootstrap_summary", with_tables(_SAMPLE, "SELECT grp, round(stddev_samp(rate), 6) AS se, round(avg(CASE WHEN rate = 0 THEN 1.0 ELSE 0.0 END), 8) AS zero_share FROM drawn GROUP BY grp"))
def x26(spark, d):
    return _drawn(spark, d).groupBy("grp").agg(F.round(F.stddev_samp("rate"), 6).alias("se"), F.round(F.avg((c("rate") == 0).cast("double")), 8).alias("zero_share"))
