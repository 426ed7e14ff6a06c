"""Counter-based randomness and resampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quantiles as Q
from ..functions import rng
from ..functions import scalars as S
from ..operators import bootstrap as B
from ..operators import rates as R
from ..operators import windows as X
from ..sources.cases import cases
from ..sources.shared import store
from .ordered import _LADDER, _inverse_sql
from .projections import TIER_SQL
from .registry import query, with_tables

c = F.col
SEED = 11
DRAWS = 40


_RNG = """
weyl AS (SELECT *, CAST((seed + CAST(k AS HUGEINT) * 1831565813) % 4294967296 AS BIGINT) AS a FROM idx),
s1 AS (SELECT *, CAST((CAST(xor(a, a >> 15) AS HUGEINT) * CAST(a | 1 AS HUGEINT)) % 4294967296 AS BIGINT) AS x FROM weyl),
s2 AS (SELECT *, CAST((CAST(x AS HUGEINT) + (CAST(xor(x, x >> 7) AS HUGEINT) * CAST(x | 61 AS HUGEINT)) % 4294967296) % 4294967296 AS BIGINT) AS y FROM s1),
s3 AS (SELECT *, xor(x, y) AS z FROM s2),
uni AS (SELECT *, xor(z, z >> 14) / CAST(4294967296 AS DOUBLE) AS u FROM s3)"""


@query("rng01_counter_stream", with_tables("idx AS (SELECT CAST(11 AS BIGINT) AS seed, CAST(i AS BIGINT) AS k FROM (SELECT DISTINCT part AS i FROM cases))," + _RNG, "SELECT k, u FROM uni"))
def rng01(spark, d):
    keys = cases(spark, d).select(c("part").alias("k")).distinct()
    return keys.select("k", rng.uniform(F.lit(SEED).cast("long"), c("k")).alias("u"))


@query("rng03_hash_uniform", "SELECT case_id, CAST('0x' || substr(sha256('7|' || case_id), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS u FROM cases")
def rng03(spark, d):
    return cases(spark, d).select("case_id", rng.hash_uniform(F.lit(7), c("case_id")).alias("u"))


_SAMPLE = f"""
cells AS (SELECT * REPLACE (grp || '|' || period AS grp) FROM cases),
smp AS (SELECT grp, weight * err AS we, weight * base AS wb, weight * CASE WHEN line = 3 THEN 0 ELSE err END AS ws, row_number() OVER (PARTITION BY grp ORDER BY case_id) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM cells),
sz AS (SELECT DISTINCT grp, n FROM smp),
idx AS (SELECT grp, n, d AS draw, CAST({SEED} AS BIGINT) AS seed, CAST(d * n + j AS BIGINT) AS k FROM sz, range(0, {DRAWS}) t(d), LATERAL (SELECT unnest(range(1, n + 1)) AS j)),{_RNG},
pick AS (SELECT grp, draw, CAST(floor(u * n) AS BIGINT) AS i FROM uni),
drawn AS (SELECT p.grp, CAST(draw AS INTEGER) AS draw, sum(we) * 100 / sum(wb) AS rate, sum(ws) * 100 / sum(wb) AS rate_cut FROM pick p JOIN smp s ON p.grp = s.grp AND p.i = s.i GROUP BY p.grp, draw)"""


def _cells(spark, d):
    """A group is a jurisdiction's review sample of one period."""
    return cases(spark, d).withColumn("grp", F.concat_ws("|", "grp", "period"))


def _drawn(spark, d):
    rows = _cells(spark, d)
    w = c("weight")
    cut = F.when(c("line") == 3, 0.0).otherwise(c("err"))
    s = B.samples(rows, "grp", ["case_id"], we=w * c("err"), wb=w * c("base"), ws=w * cut)
    t = B.draw_sums(s, "grp", DRAWS, SEED, ["we", "wb", "ws"])
    return t.select("grp", "draw", (c("we") * 100 / c("wb")).alias("rate"), (c("ws") * 100 / c("wb")).alias("rate_cut"))


@query("bst01_ratio_bootstrap", with_tables(_SAMPLE, "SELECT grp, draw, round(rate, 6) AS rate, round(rate_cut, 6) AS rate_cut FROM drawn"))
def bst01(spark, d):
    return _drawn(spark, d).select("grp", "draw", F.round("rate", 6).alias("rate"), F.round("rate_cut", 6).alias("rate_cut"))


@query(
    "bst01b_recentred_tiers",
    with_tables(
        _SAMPLE + ", pt AS (SELECT grp, sum(we) * 100 / sum(wb) AS point0, sum(ws) * 100 / sum(wb) AS point1 FROM smp GROUP BY grp), moved AS (SELECT grp, 9 + (point1 - point0) + (rate_cut - point1) AS rate FROM drawn JOIN pt USING (grp))",
        f"SELECT grp, round(avg(CASE WHEN t = 15 THEN 1.0 ELSE 0.0 END), 8) AS p15, round(avg(t / CAST(100 AS DOUBLE) * 1000000), 3) AS mean_bill, round(stddev_pop(t / CAST(100 AS DOUBLE) * 1000000), 3) AS sd_bill FROM (SELECT grp, {TIER_SQL.format('rate')} AS t FROM moved) GROUP BY grp",
    ),
)
def bst01b(spark, d):
    rows = _cells(spark, d)
    cut = F.when(c("line") == 3, 0.0).otherwise(c("err"))
    points = rows.groupBy("grp").agg(R.weighted_ratio("weight", "err", "base").alias("point0"), R.weighted_ratio("weight", cut, "base").alias("point1"), F.lit(9.0).alias("official"))
    moved = B.recentred(_drawn(spark, d).select("grp", c("rate_cut").alias("rate")), points, ["grp"], "official")
    s = R.draw_summary(moved, ["grp"], "rate", F.lit(1e6))
    return s.select("grp", F.round("p15", 8).alias("p15"), F.round("mean_bill", 3).alias("mean_bill"), F.round("sd_bill", 3).alias("sd_bill"))


@query("bst02_cell_variance", with_tables(_SAMPLE, "SELECT grp, round(var_samp(rate), 6) AS variance FROM drawn GROUP BY grp"))
def bst02(spark, d):
    return _drawn(spark, d).groupBy("grp").agg(F.round(F.var_samp("rate"), 6).alias("variance"))


@query("bst03_paired_interval", with_tables(_SAMPLE, "SELECT grp, round(stddev_samp(rate_cut - rate), 6) AS se, round(quantile_cont(rate_cut - rate, 0.025), 6) + 0.0 AS low, round(quantile_cont(rate_cut - rate, 0.975), 6) + 0.0 AS high FROM drawn GROUP BY grp"))
def bst03(spark, d):
    paired = _drawn(spark, d).withColumn("delta", c("rate_cut") - c("rate"))
    i = B.percentile_interval(paired, ["grp"], "delta")
    return i.select("grp", F.round("se", 6).alias("se"), (F.round("low", 6) + 0.0).alias("low"), (F.round("high", 6) + 0.0).alias("high"))


@query("bst04_robust_draws", with_tables(_SAMPLE, "SELECT draw, round(median(rate), 6) AS median, round(mad(rate) / 0.67449, 6) AS mad_sd FROM drawn GROUP BY draw"))
def bst04(spark, d):
    x = _drawn(spark, d)
    centre = x.groupBy("draw").agg(F.percentile("rate", F.lit(0.5)).alias("m"))
    away = x.join(centre, "draw").groupBy("draw").agg(F.first("m").alias("m"), F.percentile(F.abs(c("rate") - c("m")), F.lit(0.5)).alias("mad"))
    return away.select("draw", F.round("m", 6).alias("median"), F.round(c("mad") / 0.67449, 6).alias("mad_sd"))


_MODEL = f"""
mc AS (SELECT grp || '|' || period AS grp, case_id, weight, base, amount, ln(greatest(amount, CAST(1 AS DOUBLE))) AS centre, row_number() OVER (PARTITION BY grp, period ORDER BY case_id) - 1 AS i, count(*) OVER (PARTITION BY grp, period) AS n FROM cases),
sz AS (SELECT DISTINCT grp, n FROM mc),
idx AS (SELECT grp, n, d AS draw, j, CAST({SEED} AS BIGINT) AS seed, CAST((d * n + j) * 3 + t + 1 AS BIGINT) AS k, t FROM sz, range(0, 20) x(d), LATERAL (SELECT unnest(range(0, n)) AS j), range(0, 3) y(t)),{_RNG},
three AS (SELECT grp, n, draw, j, max(u) FILTER (WHERE t = 0) AS u1, max(u) FILTER (WHERE t = 1) AS u2, max(u) FILTER (WHERE t = 2) AS u3 FROM uni GROUP BY grp, n, draw, j)"""


@query(
    "bst06_model_bootstrap",
    with_tables(
        _MODEL,
        "SELECT t.grp, CAST(draw AS INTEGER) AS draw, round(sum(weight * CASE WHEN u2 < 0.4 AND least(exp(centre + (u3 - 0.5)), base * 0.1) > 200 THEN least(exp(centre + (u3 - 0.5)), base * 0.1) ELSE 0 END) * 100 / sum(weight * base), 6) AS rate FROM three t JOIN mc ON t.grp = mc.grp AND mc.i = floor(u1 * t.n) GROUP BY t.grp, draw",
    ),
)
def bst06(spark, d):
    rows = _cells(spark, d)
    centre = F.ln(F.greatest("amount", F.lit(1.0)))
    s = B.samples(rows, "grp", ["case_id"], weight=c("weight"), base=c("base"), centre=centre)

    def one(r, draw: int) -> list[float]:
        import numpy as np

        # Three uniforms an occurrence, always: which row, whether it deviates, and by how much.
        n = len(r)
        u = [rng.uniforms(SEED, (draw * n + np.arange(n)) * 3 + t + 1) for t in range(3)]
        at = (u[0] * n).astype(np.int64)
        w, base, mid = (r[k].to_numpy()[at] for k in ("weight", "base", "centre"))
        size = np.minimum(np.exp(mid + (u[2] - 0.5)), base * 0.1)
        return [float((w * np.where((u[1] < 0.4) & (size > 200), size, 0.0)).sum()), float((w * base).sum())]

    def large(r, sizes):
        size = F.least(F.exp(c("centre") + (c("u2") - 0.5)), c("base") * 0.1)
        e = F.when((c("u1") < 0.4) & (size > 200), size).otherwise(0.0)
        picked = B.occurrences(sizes, "grp", 20, SEED, uniforms=3).join(r, ["grp", "_place"])
        return picked.groupBy("grp", "draw").agg(F.sum(c("weight") * e).alias("e"), F.sum(c("weight") * c("base")).alias("b"))

    t = B.per_draw(s, "grp", 20, ["e", "b"], one, large)
    return t.select("grp", "draw", F.round(c("e") * 100 / c("b"), 6).alias("rate"))


@query("bst07_over_seeds", with_tables(_SAMPLE, "SELECT grp, round(avg(m), 6) AS mean, round(stddev_samp(m) / sqrt(count(*)), 6) AS mc_se FROM (SELECT grp, draw % 8 AS seed, avg(rate) AS m FROM drawn GROUP BY 1, 2) GROUP BY grp"))
def bst07(spark, d):
    per = _drawn(spark, d).groupBy("grp", (c("draw") % 8).alias("seed")).agg(F.avg("rate").alias("m"))
    return B.over_seeds(per, ["grp"], "m").select("grp", F.round("mean", 6).alias("mean"), F.round("mc_se", 6).alias("mc_se"))


SEEDS = [SEED + 10_000 * i for i in range(8)]
_SEEDED = f"""
cells AS (SELECT * REPLACE (grp || '|' || period AS grp) FROM cases),
smp AS (SELECT grp, weight * err AS we, weight * base AS wb, row_number() OVER (PARTITION BY grp ORDER BY case_id) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM cells),
sz AS (SELECT DISTINCT grp, n FROM smp),
idx AS (SELECT grp, n, d AS draw, CAST({SEED} + 10000 * s AS BIGINT) AS seed, CAST(d * n + j AS BIGINT) AS k FROM sz, range(0, {len(SEEDS)}) r(s), range(0, 5) t(d), LATERAL (SELECT unnest(range(1, n + 1)) AS j)),{_RNG},
means AS (SELECT grp, seed, avg(rate) AS m FROM (SELECT v.grp, seed, draw, sum(we) * 100 / sum(wb) AS rate FROM uni v JOIN smp ON v.grp = smp.grp AND smp.i = CAST(floor(v.u * v.n) AS BIGINT) GROUP BY v.grp, seed, draw) GROUP BY grp, seed)"""


@query("bst07b_own_seeds", with_tables(_SEEDED, "SELECT grp, round(avg(m), 6) AS mean, round(stddev_samp(m) / sqrt(count(*)), 6) AS mc_se, round(max(m) - min(m), 6) AS spread FROM means GROUP BY grp"))
def bst07b(spark, d):
    """Eight seeds, each a stream of its own with five draws: the mean over seeds, its Monte Carlo error and the seeds' spread."""
    w = c("weight")
    s = B.samples(_cells(spark, d), "grp", ["case_id"], we=w * c("err"), wb=w * c("base"))
    t = B.seeded_sums(s, "grp", 5, SEEDS, ["we", "wb"])
    per = t.groupBy("grp", "seed").agg(F.avg(c("we") * 100 / c("wb")).alias("m"))
    wide = per.groupBy("grp").agg((F.max("m") - F.min("m")).alias("spread"))
    return B.over_seeds(per, ["grp"], "m").join(wide, "grp").select("grp", *[F.round(x, 6).alias(x) for x in ("mean", "mc_se", "spread")])


@query(
    "bst08_drift_band",
    with_tables(
        f"idx AS (SELECT CAST(d AS INTEGER) AS draw, CAST(77 AS BIGINT) AS seed, CAST(2 * d + t + 1 AS BIGINT) AS k, t FROM range(0, {DRAWS}) x(d), range(0, 2) y(t))," + _RNG + ", z AS (SELECT draw, sqrt(-2 * ln(greatest(max(u) FILTER (WHERE t = 0), CAST(1e-12 AS DOUBLE)))) * cos(2 * CAST(3.141592653589793 AS DOUBLE) * max(u) FILTER (WHERE t = 1)) AS z FROM uni GROUP BY draw)",
        "SELECT grp, draw, round(grp_no + 1.5 * z, 6) + 0.0 AS rate FROM (SELECT DISTINCT grp, grp_no FROM cases), z",
    ),
)
def bst08(spark, d):
    seed = F.lit(77).cast("long")
    draws = spark.range(DRAWS).select(c("id").cast("int").alias("draw"), S.normal_of(rng.uniform(seed, 2 * c("id") + 1), rng.uniform(seed, 2 * c("id") + 2)).alias("z"))
    return cases(spark, d).select("grp", "grp_no").distinct().crossJoin(F.broadcast(draws)).select("grp", "draw", (F.round(c("grp_no") + 1.5 * c("z"), 6) + 0.0).alias("rate"))


@query("bst09_model_anchor", with_tables(_SAMPLE, "SELECT grp, draw, round(rate_cut + 9 - avg(rate) OVER (PARTITION BY grp), 6) AS rate FROM drawn"))
def bst09(spark, d):
    x = _drawn(spark, d)
    base = x.groupBy("grp").agg(F.avg("rate").alias("m"))
    return x.join(base, "grp").select("grp", "draw", F.round(c("rate_cut") + 9 - c("m"), 6).alias("rate"))


@query(
    "bst11_intervention_grid",
    with_tables(
        "r AS (SELECT *, coalesce(sum(weight) OVER (PARTITION BY grp ORDER BY score DESC, case_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(weight) OVER (PARTITION BY grp) AS total FROM cases)",
        "SELECT grp, coverage, effect, round(sum(weight * err * (1 - effect * greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), (total * coverage - before) / weight)))) * 100 / sum(weight * base), 6) AS rate FROM r, (VALUES (CAST(0.05 AS DOUBLE)), (CAST(0.1 AS DOUBLE)), (CAST(0.2 AS DOUBLE))) a(coverage), (VALUES (CAST(0.5 AS DOUBLE)), (CAST(1 AS DOUBLE))) b(effect) GROUP BY grp, coverage, effect",
    ),
)
def bst11(spark, d):
    rows = store(cases(spark, d).select("grp", "score", "case_id", "weight", "base", "err"), "ranked")
    # Every setting is one more column of sums over the same rows.
    grid = [(a, b) for a in (0.05, 0.1, 0.2) for b in (0.5, 1.0)]
    ranked = rows.join(X.budget_cuts(rows, ["grp"], {"score": "score"}, ["case_id"], "weight", [0.05, 0.1, 0.2]), "grp")
    share = lambda a: X.inside_cut("score", ["case_id"], "weight", "score", a)
    sums = ranked.groupBy("grp").agg(*[R.weighted_ratio("weight", c("err") * (1 - b * share(a)), "base").alias(f"r{i}") for i, (a, b) in enumerate(grid)])
    out = F.array(*[F.struct(F.lit(a).alias("coverage"), F.lit(b).alias("effect"), F.round(f"r{i}", 6).alias("rate")) for i, (a, b) in enumerate(grid)])
    return sums.select("grp", F.inline(out))


_DRAWN_SIZE = f"""u AS (SELECT *, {_LADDER} AS q, CASE WHEN status IN (2, 3) THEN amount ELSE 0 END AS size0, {", ".join(f"CAST('0x' || substr(sha256('{i}|' || case_id), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS u{i}" for i in range(3))} FROM cases),
z AS (SELECT case_id, u0, u1, least(exp({_inverse_sql("u2")}), greatest(base * 0.1, abs(size0))) AS size FROM u)"""


@query("qnt04_signed_draws", with_tables(_DRAWN_SIZE, "SELECT case_id, round(CASE WHEN u0 < 0.4 THEN CASE WHEN u1 < 0.6 THEN size ELSE -size END ELSE 0 END, 6) + 0.0 AS drawn FROM z"))
def qnt04(spark, d):
    """Signed, capped deviations drawn from each case's quantile function."""
    steps = (3.0, 3.4, 4.1, 5.0, 5.8, 6.6, 7.1, 7.6, 8.2)
    u = [rng.hash_uniform(F.lit(i), c("case_id")) for i in range(3)]
    size = F.least(F.exp(Q.inverse(u[2], F.array(*[F.lit(s) + F.ln(1 + c("line")) for s in steps]), F.lit(0.4))), F.greatest(c("base") * 0.1, F.abs("deviation")))
    x = F.when(u[0] < 0.4, F.when(u[1] < 0.6, size).otherwise(-size)).otherwise(0.0)
    return cases(spark, d).select("case_id", (F.round(x, 6) + 0.0).alias("drawn"))
