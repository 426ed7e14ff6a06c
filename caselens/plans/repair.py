"""Reconstruction of cases by steps, and repair of coverage by an inverse curve."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import curves
from ..functions import quantiles as Q
from ..functions import scalars as S
from ..operators import solver
from ..sources.cases import cases
from .ordered import _Q, _quantiles
from .registry import query, with_tables

c = F.col
MOST = 120


def _chain_sql(income: str) -> str:
    """The benefit chain of PRJ-23 with the unearned part of the income as given."""
    adjusted = f"greatest(CAST(0 AS DOUBLE), base / 40 + ({income}) - floor(CAST(0.2 AS DOUBLE) * (base / 40) + 0.5) - 193)"
    excess = f"least(CAST(672 AS DOUBLE), greatest(CAST(0 AS DOUBLE), amount / 4 - floor({adjusted} / 2 + 0.5)))"
    net = f"greatest(CAST(0 AS DOUBLE), floor({adjusted} - {excess} + 0.5))"
    return f"greatest(CASE WHEN line <= 2 THEN CAST(23 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END, greatest(CAST(0 AS DOUBLE), 200 + 160 * line - CAST(ceil(CAST(0.3 AS DOUBLE) * {net}) AS BIGINT)))"


_REASON = "CASE WHEN abs(target - reached) <= 3 THEN 'matched' WHEN (CASE WHEN target > recorded THEN reached > target ELSE reached < target END) THEN 'passed' WHEN (CASE WHEN target > recorded THEN income <= 0 ELSE reached <= 0 END) THEN 'empty' END"
_NEXT = "CASE WHEN target > recorded THEN greatest(income - 3, CAST(0 AS DOUBLE)) ELSE income + 3 END"


@query(
    "opt09b_benefit_walk",
    with_tables(
        f"""seen AS (SELECT case_id, base, amount, line, base / 40 AS income, {_chain_sql('base / 40')} AS recorded, floor(deviation / 200 + 0.5) AS shift FROM cases),
walk AS (SELECT case_id, base, amount, line, recorded, greatest(CAST(0 AS DOUBLE), recorded + shift) AS target, 0 AS steps, income, recorded AS reached FROM seen
  UNION ALL SELECT case_id, base, amount, line, recorded, target, steps + 1, {_NEXT}, {_chain_sql(_NEXT)} FROM walk WHERE ({_REASON}) IS NULL AND steps < {MOST}),
ends AS (SELECT * FROM walk WHERE ({_REASON}) IS NOT NULL OR steps = {MOST})""",
        f"SELECT case_id, steps, round(income - base / 40, 6) + 0.0 AS moved, reached, coalesce({_REASON}, 'not solved') AS reason FROM ends",
    ),
)
def opt09b(spark, d):
    """Unearned income stepped until the whole benefit chain meets the benefit that was paid."""
    most = (200 + 160 * c("line")).cast("double")
    rows = cases(spark, d).select("case_id", (c("base") / 40).alias("income"), (c("base") / 40).alias("earned"), "line", (c("amount") / 4).alias("shelter"), most.alias("most"), "deviation")
    rows = rows.withColumn("recorded", S.benefit(c("earned") + c("income"), c("earned"), c("line"), c("shelter"), most=c("most"), least=F.lit(23.0))["benefit"])
    rows = rows.withColumn("target", F.greatest(F.lit(0.0), c("recorded") + F.floor(c("deviation") / 200 + 0.5)))
    paid = lambda income, x: S.benefits(x["earned"] + income, x["earned"], x["line"], x["shelter"], x["most"], 23.0)
    out = solver.walk(rows, "case_id", "income", "target", "recorded", ["earned", "line", "shelter", "most"], paid, most=MOST)
    return out.select("case_id", "steps", (F.round(c("income") - c("start"), 6) + 0.0).alias("moved"), "reached", "reason")


_LEVELS = ", ".join(f"({i + 1}, CAST({p} AS DOUBLE))" for i, p in enumerate(Q.LEVELS))
_KNOTS = f"""{_Q}, lv AS (SELECT * FROM (VALUES {_LEVELS}) t(k, level)),
cov AS (SELECT region, k, level, round(sum(CASE WHEN amount <= 0 OR ln(amount) <= q[k] THEN weight ELSE 0 END) / sum(weight), 8) AS covered FROM q JOIN (SELECT case_id, region FROM cases) USING (case_id), lv GROUP BY region, k, level),
ends AS (SELECT region, k, level, covered FROM cov UNION ALL SELECT DISTINCT region, 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM cov UNION ALL SELECT DISTINCT region, 10, CAST(1 AS DOUBLE), CAST(1 AS DOUBLE) FROM cov),
rise AS (SELECT region, k, level, max(covered) OVER (PARTITION BY region ORDER BY k ROWS UNBOUNDED PRECEDING) AS x FROM ends),
knot AS (SELECT region, x, max(level) AS y FROM rise GROUP BY region, x),
seg AS (SELECT region, x, y, lead(x) OVER (PARTITION BY region ORDER BY x) AS x2, lead(y) OVER (PARTITION BY region ORDER BY x) AS y2 FROM knot)"""


@query(
    "win08b_remap",
    with_tables(
        _KNOTS,
        "SELECT region, level, n_knots, round(least(y + (level - x) / (x2 - x) * (y2 - y), 1 - CAST(1e-12 AS DOUBLE)), 8) AS source_level FROM lv JOIN seg ON level >= x AND level < x2 JOIN (SELECT region, count(*) AS n_knots FROM knot GROUP BY region) USING (region)",
    ),
)
def win08b(spark, d):
    """The levels to ask for so that each region's quantiles cover what they say: the inverse of its coverage curve."""
    w = c("weight")
    hit = [F.round(F.sum(F.when((c("amount") <= 0) | (F.ln("amount") <= F.get("q", F.lit(i))), w).otherwise(0.0)) / F.sum(w), 8) for i in range(len(Q.LEVELS))]
    one = _quantiles(spark, d).groupBy("region").agg(F.array(F.lit(0.0), *hit, F.lit(1.0)).alias("covered"))
    source = F.array(*[F.lit(float(p)) for p in (0, *Q.LEVELS, 1)])
    curve = one.select("region", curves.collapsed(curves.rising(c("covered")), source).alias("knots"))
    rows = curve.select("region", F.size("knots").cast("long").alias("n_knots"), "knots", F.explode(F.array(*[F.lit(float(p)) for p in Q.LEVELS])).alias("level"))
    return rows.select("region", "level", "n_knots", F.round(F.least(curves.interpolated(c("level"), c("knots")), F.lit(1 - 1e-12)), 8).alias("source_level"))
