"""The library's registered queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.rates import weighted_ratio
from ..sources.cases import CASES_SQL, cases

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}

PANEL_SQL = "panel AS (SELECT grp, grp_no, period, count(*) AS n, sum(weight) AS w, round(sum(weight * err) * 100 / sum(weight * base), 10) AS rate FROM cases GROUP BY grp, grp_no, period)"


def query(name: str, sql: str | None = None):
    """Registers a query; ``sql`` starts after the case view's common tables unless it has its own WITH."""

    def add(f):
        _queries[name] = f
        if sql is not None:
            _sql[name] = sql if sql.lstrip().upper().startswith("WITH") else f"WITH {CASES_SQL}, {PANEL_SQL}\n{sql}"
        return f

    return add


def with_tables(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {CASES_SQL}, {PANEL_SQL}, {ctes}\n{body}"


def panel(spark: SparkSession, d: str) -> DataFrame:
    """Case count, weight and error rate of every group and period."""
    rate = F.round(weighted_ratio("weight", "err", "base"), 10)
    return cases(spark, d).groupBy("grp", "grp_no", "period").agg(F.count("*").alias("n"), F.sum("weight").alias("w"), rate.alias("rate"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Weighted error rates by group, with their tiers."""
    rates = cases(spark, d).groupBy("grp").agg(F.count("*").alias("n"), F.round(weighted_ratio("weight", "err", "base"), 6).alias("rate"))
    return rates.withColumn("tier", S.tier(F.col("rate")))


def _load() -> None:
    from . import aggregates, extras, features, learning, models, ordered, persistence, projections, relations, repair, simulation, studies  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
