"""Projection and scalar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import attribution as A
from ..operators.rates import weighted_ratio
from ..sources.cases import cases, table, threshold
from .registry import panel, query, with_tables

c = F.col
TIER_SQL = "CASE WHEN {0} < 6 THEN 0 WHEN {0} < 8 THEN 5 WHEN {0} < 10 THEN 10 ELSE 15 END"


@query("prj01_tier", f"SELECT grp, period, rate, {TIER_SQL.format('rate')} AS tier FROM panel")
def prj01(spark, d):
    return panel(spark, d).select("grp", "period", "rate", S.tier(c("rate")).alias("tier"))


@query("prj02_valid_tier", f"SELECT grp, CAST(max({TIER_SQL.format('rate')}) AS INTEGER) AS worst FROM panel GROUP BY grp")
def prj02(spark, d):
    return panel(spark, d).groupBy("grp").agg(F.max(S.valid_tier(c("rate"))).alias("worst"))


@query("prj03_delay", "SELECT grp, period, rate * 1.5 >= 20 AS delays FROM panel")
def prj03(spark, d):
    return panel(spark, d).select("grp", "period", S.delays(c("rate")).alias("delays"))


def _elements():
    return F.array_distinct(F.array((300 + c("part") % 8).cast("int"), (300 + c("supp") % 8).cast("int")))


_ELEMENTS = "list_distinct([CAST(300 + part % 8 AS INTEGER), CAST(300 + supp % 8 AS INTEGER)])"


@query("prj04_lever", f"SELECT case_id, round(CASE WHEN err = 0 THEN err ELSE err * (1 - 0.75 * len(list_intersect({_ELEMENTS}, [301, 302])) / len({_ELEMENTS})) END, 8) AS err FROM cases")
def prj04(spark, d):
    return cases(spark, d).select("case_id", F.round(S.lever_error(c("err"), _elements(), [301, 302], 0.75), 8).alias("err"))


@query("prj05_targeted", "SELECT case_id, round(CASE WHEN status = 2 THEN err * 0.5 ELSE err END, 8) AS err FROM cases")
def prj05(spark, d):
    return cases(spark, d).select("case_id", F.round(S.targeted_error(c("err"), c("status") == 2, 0.5), 8).alias("err"))


_CODES = "list_distinct(list_filter([agency1, agency2], lambda x: x IS NOT NULL))"


@query("prj06_share_cut", f"SELECT case_id, round(err * (1 - 0.5 * len(list_intersect({_CODES}, [17, 19, 20])) / len({_CODES})), 8) AS err FROM cases")
def prj06(spark, d):
    codes = A.codes("agency1", "agency2")
    strict = F.size(F.array_intersect(codes, F.array(*[F.lit(x) for x in S.CODE_SETS["strict"]])))
    return cases(spark, d).select("case_id", F.round(S.share_cut(c("err"), F.size(codes), strict, 0.5), 8).alias("err"))


@query(
    "prj07_flag_shift",
    """SELECT grp, round(grp_no % 5 + 10 + sum(weight * CASE WHEN line = 3 THEN 0 ELSE err END) * 100 / sum(weight * base) - sum(weight * err) * 100 / sum(weight * base), 8) AS rate
    FROM cases GROUP BY grp, grp_no""",
)
def prj07(spark, d):
    kept = F.when(c("line") == 3, 0.0).otherwise(c("err"))
    shifted = c("grp_no") % 5 + 10 + weighted_ratio("weight", kept, "base") - weighted_ratio("weight", "err", "base")
    return cases(spark, d).groupBy("grp", "grp_no").agg(F.round(shifted, 8).alias("rate")).drop("grp_no")


@query("prj08_official_label", "SELECT grp, period, CAST(count(*) FILTER (WHERE status IN (2, 3) AND amount > 1000 + 100 * (period - 1995)) AS BIGINT) AS errors FROM cases GROUP BY grp, period")
def prj08(spark, d):
    label = S.counted(c("status"), c("amount"), threshold(c("period")))
    return cases(spark, d).groupBy("grp", "period").agg(F.count_if(label).alias("errors"))


@query("prj09_missing", "SELECT grp, CAST(sum(CASE WHEN agency2 IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n FROM cases GROUP BY grp")
def prj09(spark, d):
    return cases(spark, d).groupBy("grp").agg(F.sum(S.missing(c("agency2"))).alias("n"))


@query("prj10_nonnegative", "SELECT case_id, CASE WHEN deviation >= 0 THEN round(deviation, 8) END AS value FROM cases WHERE orderkey % 10 < 10")
def prj10(spark, d):
    return cases(spark, d).select("case_id", F.round(S.nonnegative(c("deviation")), 8).alias("value"))


@query("prj11_paired_any", "SELECT case_id, coalesce(agency1 IN (17, 19, 20) AND amount > 500, FALSE) OR coalesce(agency2 IN (17, 19, 20) AND discount > 0.05, FALSE) AS hit FROM cases")
def prj11(spark, d):
    slots = F.array(F.struct(c("agency1").alias("code"), (c("amount") > 500).alias("pays")), F.struct(c("agency2").alias("code"), (c("discount") > 0.05).alias("pays")))
    return cases(spark, d).select("case_id", F.exists(slots, lambda s: F.coalesce(s["code"].isin(17, 19, 20) & s["pays"], F.lit(False))).alias("hit"))


@query("prj12_documentation", "SELECT grp, count(*) FILTER (WHERE base > 30000 AND line IN (1, 2) AND NOT (score > 0.04)) AS n FROM cases GROUP BY grp")
def prj12(spark, d):
    return cases(spark, d).groupBy("grp").agg(F.count_if((c("base") > 30000) & c("line").isin(1, 2) & ~(c("score") > 0.04)).alias("n"))


@query(
    "prj13_certification",
    """SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) % 12 + 1 AS length, CAST(o_orderkey % 15 AS BIGINT) BETWEEN 1 AND CAST(month(o_orderdate) AS INTEGER) % 12 + 1 AS valid,
    CAST(o_orderkey % 15 AS BIGINT) >= CAST(month(o_orderdate) AS INTEGER) % 12 AS near_end FROM orders""",
)
def prj13(spark, d):
    length = (F.month("o_orderdate") % 12 + 1).cast("int")
    since = c("o_orderkey") % 15
    return table(spark, d, "orders").select("o_orderkey", length.alias("length"), since.between(1, length).alias("valid"), (since >= length - 1).alias("near_end"))


@query("prj14_interactions", "SELECT grp, status, CAST(sum(CASE WHEN grp_no % 2 = 0 AND line > 3 THEN 1 ELSE 0 END) AS BIGINT) AS both_on, CAST(sum(CASE WHEN grp_no % 2 = 0 AND NOT line > 3 THEN 1 ELSE 0 END) AS BIGINT) AS one_on FROM cases GROUP BY grp, status")
def prj14(spark, d):
    on, large = c("grp_no") % 2 == 0, c("line") > 3
    return cases(spark, d).groupBy("grp", "status").agg(F.sum((on & large).cast("int")).alias("both_on"), F.sum((on & ~large).cast("int")).alias("one_on"))


_PREMIUM = {1995: 46.1, 1996: 42.5, 1997: 43.8, 1998: 43.8, 1999: 45.5, 2000: 45.5, 2001: 50.0}
_PREMIUM_SQL = "premium(period, premium) AS (VALUES " + ", ".join(f"({y}, CAST({p} AS DOUBLE))" for y, p in _PREMIUM.items()) + ")"


@query(
    "prj15_premium_bands",
    with_tables(
        _PREMIUM_SQL,
        """SELECT case_id, round(base / 1000 - premium, 8) + 0.0 AS distance, abs(base / 1000 - premium) <= 1 + 1e-9 AS within_1, abs(base / 1000 - premium) <= 5 + 1e-9 AS within_5
        FROM cases JOIN premium USING (period)""",
    ),
)
def prj15(spark, d):
    premium = spark.createDataFrame(list(_PREMIUM.items()), "period int, premium double")
    away = c("base") / 1000 - c("premium")
    return cases(spark, d).join(F.broadcast(premium), "period").select("case_id", (F.round(away, 8) + 0.0).alias("distance"), (F.abs(away) <= 1 + 1e-9).alias("within_1"), (F.abs(away) <= 5 + 1e-9).alias("within_5"))


@query(
    "prj16_features",
    """SELECT case_id, round(greatest(CAST(0 AS DOUBLE), least(base / 50000, CAST(1 AS DOUBLE))), 6) AS load, CASE WHEN discount = 0 THEN NULL ELSE round(score / discount, 6) END AS ratio,
    coalesce(agency2, -1) AS code, CASE WHEN weight > 25 THEN 1 ELSE 0 END AS heavy FROM cases""",
)
def prj16(spark, d):
    ratio = F.when(c("discount") != 0, F.round(c("score") / c("discount"), 6))
    return cases(spark, d).select("case_id", F.round(F.greatest(F.lit(0.0), F.least(c("base") / 50000, F.lit(1.0))), 6).alias("load"), ratio.alias("ratio"), F.coalesce("agency2", F.lit(-1)).alias("code"), F.when(c("weight") > 25, 1).otherwise(0).alias("heavy"))


@query(
    "prj17_row_aggregates",
    """SELECT case_id, CASE WHEN agency1 IS NULL AND agency2 IS NULL THEN NULL ELSE CAST(coalesce(agency1, 0) + coalesce(agency2, 0) AS DOUBLE) END AS total,
    CAST(CASE WHEN agency1 > 0 THEN 1 ELSE 0 END + CASE WHEN agency2 > 0 THEN 1 ELSE 0 END AS INTEGER) AS positive, agency1 IS NULL OR agency2 IS NULL AS gaps FROM cases""",
)
def prj17(spark, d):
    slots = [c("agency1"), c("agency2")]
    return cases(spark, d).select("case_id", S.row_sum(slots).alias("total"), S.count_positive(slots).alias("positive"), S.any_null(slots).alias("gaps"))


@query("prj18_hurdle_targets", "SELECT grp, count(*) FILTER (WHERE abs(deviation) > 0.5) AS deviates, count(*) FILTER (WHERE err > 0) AS crosses FROM cases GROUP BY grp")
def prj18(spark, d):
    return cases(spark, d).groupBy("grp").agg(F.count_if(F.abs("deviation") > 0.5).alias("deviates"), F.count_if(c("err") > 0).alias("crosses"))


@query("prj19_cap", "SELECT case_id, round(greatest(base * 0.1, abs(deviation)), 8) AS cap FROM cases")
def prj19(spark, d):
    return cases(spark, d).select("case_id", F.round(F.greatest(c("base") * 0.1, F.abs("deviation")), 8).alias("cap"))


@query("prj20_bands", "SELECT CASE WHEN base < 10000 THEN 'low' WHEN base < 40000 THEN 'mid' ELSE 'high' END AS band, count(*) AS n FROM cases GROUP BY 1")
def prj20(spark, d):
    return cases(spark, d).groupBy(S.band(c("base"), [10000, 40000], ["low", "mid", "high"]).alias("band")).agg(F.count("*").alias("n"))


@query(
    "prj21_rounding",
    "SELECT p_partkey, CASE WHEN p_retailprice = 0 THEN CAST(0 AS DOUBLE) ELSE round(p_retailprice * pow(CAST(10 AS DOUBLE), 3 - floor(log10(abs(p_retailprice))))) / pow(CAST(10 AS DOUBLE), 3 - floor(log10(abs(p_retailprice)))) END AS significant, round_even(p_retailprice / 2, 0) + 0.0 AS half_even FROM part",
)
def prj21(spark, d):
    return table(spark, d, "part").select("p_partkey", S.significant(c("p_retailprice"), 4).alias("significant"), S.half_even(c("p_retailprice") / 2).alias("half_even"))


@query("prj22_whole_dollars", "SELECT case_id, CAST(sign(deviation) * floor(abs(deviation) + 0.5) AS BIGINT) AS away, CAST(floor(deviation + 0.5) AS BIGINT) AS up, CAST(floor(deviation) AS BIGINT) AS down, CAST(ceil(deviation) AS BIGINT) AS top FROM cases")
def prj22(spark, d):
    x = c("deviation")
    return cases(spark, d).select("case_id", S.half_away(x).alias("away"), S.half_up(x).alias("up"), F.floor(x).alias("down"), F.ceil(x).alias("top"))


_CHAIN = """chain1 AS (SELECT case_id, base, line, greatest(CAST(0 AS DOUBLE), base / 20 - floor(CAST(0.2 AS DOUBLE) * (base / 40) + 0.5) - 193) AS adjusted, amount / 4 AS shelter FROM cases),
chain2 AS (SELECT *, least(CAST(672 AS DOUBLE), greatest(CAST(0 AS DOUBLE), shelter - floor(adjusted / 2 + 0.5))) AS excess FROM chain1),
chain3 AS (SELECT *, greatest(CAST(0 AS DOUBLE), floor(adjusted - excess + 0.5)) AS net FROM chain2),
chain AS (SELECT case_id, adjusted, excess, net, CAST(ceil(CAST(0.3 AS DOUBLE) * net) AS BIGINT) AS reduction,
  greatest(CASE WHEN line <= 2 THEN CAST(23 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END, greatest(CAST(0 AS DOUBLE), 200 + 160 * line - CAST(ceil(CAST(0.3 AS DOUBLE) * net) AS BIGINT))) AS benefit FROM chain3)"""


def _chain():
    return S.benefit(c("base") / 20, c("base") / 40, c("line"), c("amount") / 4, most=(200 + 160 * c("line")).cast("double"), least=F.lit(23.0))


@query("prj23_benefit_chain", with_tables(_CHAIN, "SELECT case_id, round(adjusted, 8) AS adjusted, round(excess, 8) AS excess, net, reduction, benefit FROM chain"))
def prj23(spark, d):
    s = _chain()
    return cases(spark, d).select("case_id", F.round(s["adjusted"], 8).alias("adjusted"), F.round(s["excess_shelter"], 8).alias("excess"), s["net"].alias("net"), s["reduction"].alias("reduction"), s["benefit"].alias("benefit"))


@query(
    "prj24_first_divergence",
    with_tables(_CHAIN, "SELECT CASE WHEN round(adjusted) % 7 = 0 AND adjusted > 0 THEN 'adjusted' WHEN net <> net - net % 2 THEN 'net' WHEN reduction % 3 = 0 THEN 'reduction' END AS stage, count(*) AS n FROM chain GROUP BY 1"),
)
def prj24(spark, d):
    rows = cases(spark, d).select(*[v.alias(k) for k, v in _chain().items()])
    odd = F.when((F.round("adjusted") % 7 == 0) & (c("adjusted") > 0), c("adjusted") + 1).otherwise(c("adjusted"))
    other = F.when(c("reduction") % 3 == 0, c("reduction") + 1).otherwise(c("reduction"))
    stages = [("adjusted", c("adjusted"), odd), ("net", c("net"), c("net") - c("net") % 2), ("reduction", c("reduction"), other)]
    return rows.groupBy(S.first_difference(stages).alias("stage")).agg(F.count("*").alias("n"))


@query(
    "prj25_direction_size",
    "SELECT CASE WHEN deviation > 0 THEN 'over' WHEN deviation < 0 THEN 'under' ELSE 'none' END AS direction, CASE WHEN abs(deviation) < 100 THEN 'small' WHEN abs(deviation) < 2000 THEN 'medium' ELSE 'large' END AS size, count(*) AS n FROM cases GROUP BY 1, 2",
)
def prj25(spark, d):
    x = c("deviation")
    direction = F.when(x > 0, "over").when(x < 0, "under").otherwise("none")
    return cases(spark, d).groupBy(direction.alias("direction"), S.band(F.abs(x), [100, 2000], ["small", "medium", "large"]).alias("size")).agg(F.count("*").alias("n"))


@query(
    "prj26_decimal_tolerance",
    "SELECT p_partkey, CAST(floor(37 * CAST(p_retailprice AS DECIMAL(12, 2)) / CAST(632.30 AS DECIMAL(12, 2))) AS BIGINT) AS down, CAST(ceil(37 * CAST(p_retailprice AS DECIMAL(12, 2)) / CAST(632.30 AS DECIMAL(12, 2))) AS BIGINT) AS up FROM part",
)
def prj26(spark, d):
    exact = F.lit(37).cast("decimal(4,0)") * c("p_retailprice").cast("decimal(12,2)") / F.lit("632.30").cast("decimal(12,2)")
    return table(spark, d, "part").select("p_partkey", F.floor(exact).cast("long").alias("down"), F.ceil(exact).cast("long").alias("up"))


@query("prj27_deflated_threshold", "SELECT period, count(*) FILTER (WHERE amount > 1000 * pow(CAST(1.03 AS DOUBLE), period - 1995)) AS n FROM cases GROUP BY period")
def prj27(spark, d):
    return cases(spark, d).groupBy("period").agg(F.count_if(c("amount") > 1000 * F.pow(F.lit(1.03), c("period") - 1995)).alias("n"))


_YM = "CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER)"


@query("prj28_months_back", "SELECT o_orderkey, CAST(((year(o_orderdate) * 12 + month(o_orderdate) - 1 - o_orderkey % 20) // 12) * 100 + (year(o_orderdate) * 12 + month(o_orderdate) - 1 - o_orderkey % 20) % 12 + 1 AS INTEGER) AS began FROM orders")
def prj28(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.months_back((F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("int"), c("o_orderkey") % 20).alias("began"))


@query("prj29_fiscal_year", "SELECT CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) >= 10 THEN 1 ELSE 0 END AS INTEGER) AS fiscal, count(*) AS n FROM orders GROUP BY 1")
def prj29(spark, d):
    return table(spark, d, "orders").groupBy(S.fiscal_year((F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("int")).alias("fiscal")).agg(F.count("*").alias("n"))


@query(
    "prj30_movement",
    f"""SELECT a.grp, a.period, round(b.rate - a.rate, 8) + 0.0 AS delta, round((b.rate - a.rate) / (a.n / 100.0), 8) + 0.0 AS z, abs((b.rate - a.rate) / (a.n / 100.0)) > 1.96 * sqrt(CAST(2 AS DOUBLE)) AS noisy,
    {TIER_SQL.format('a.rate')} AS tier_before, {TIER_SQL.format('b.rate')} AS tier_after, {TIER_SQL.format('a.rate')} <> {TIER_SQL.format('b.rate')} AS changed
    FROM panel a JOIN panel b ON a.grp = b.grp AND b.period = a.period + 1""",
)
def prj30(spark, d):
    p = panel(spark, d)
    after = p.select("grp", (c("period") - 1).alias("period"), c("rate").alias("later"))
    delta, spread = c("later") - c("rate"), c("n") / 100.0
    z = F.when(spread > 0, delta / spread).otherwise(F.signum(delta) * float("inf"))
    before, then = S.tier(c("rate")), S.tier(c("later"))
    return p.join(after, ["grp", "period"]).select("grp", "period", (F.round(delta, 8) + 0.0).alias("delta"), (F.round(z, 8) + 0.0).alias("z"), (F.abs(z) > 1.96 * 2**0.5).alias("noisy"), before.alias("tier_before"), then.alias("tier_after"), (before != then).alias("changed"))


@query("prj31_normal", "SELECT part, round(sqrt(-2 * ln(greatest((part % 97 + 0.5) / 97, CAST(1e-12 AS DOUBLE)))) * cos(2 * CAST(3.141592653589793 AS DOUBLE) * ((part % 89) / CAST(89 AS DOUBLE))), 6) + 0.0 AS z FROM (SELECT DISTINCT part FROM cases)")
def prj31(spark, d):
    z = S.normal_of((c("part") % 97 + 0.5) / 97, (c("part") % 89) / 89.0)
    return cases(spark, d).select("part").distinct().select("part", (F.round(z, 6) + 0.0).alias("z"))


@query("prj32_reanchor", "SELECT a.grp, a.period, round(grp_no % 7 + a.rate - b.rate, 5) + 0.0 AS rate FROM panel a JOIN (SELECT grp, rate FROM panel WHERE period = 1995) b USING (grp)")
def prj32(spark, d):
    p = panel(spark, d)
    start = p.where("period = 1995").select("grp", c("rate").alias("start"))
    return p.join(start, "grp").select("grp", "period", (F.round(c("grp_no") % 7 + c("rate") - c("start"), 5) + 0.0).alias("rate"))


@query("prj33_direction", "SELECT grp, period, CASE WHEN grp_no % 2 = 0 THEN rate ELSE -rate END + 0.0 AS effect, CASE WHEN grp_no % 2 = 0 THEN rate - 1 ELSE -(rate + 1) END + 0.0 AS low, CASE WHEN grp_no % 2 = 0 THEN rate + 1 ELSE -(rate - 1) END + 0.0 AS high FROM panel")
def prj33(spark, d):
    keep, r = c("grp_no") % 2 == 0, c("rate")
    return panel(spark, d).select("grp", "period", (F.when(keep, r).otherwise(-r) + 0.0).alias("effect"), (F.when(keep, r - 1).otherwise(-(r + 1)) + 0.0).alias("low"), (F.when(keep, r + 1).otherwise(-(r - 1)) + 0.0).alias("high"))
