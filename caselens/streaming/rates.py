"""An extension: weighted rates kept up over arriving cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.rates import weighted_ratio


def rates_by_window(stream: DataFrame, time: str, length: str, late: str, group: str) -> DataFrame:
    """Rates and tiers per group and event-time window; rows later than ``late`` are dropped with the window's state."""
    g = stream.withWatermark(time, late).groupBy(F.window(time, length), group).agg(F.count("*").alias("n"), weighted_ratio("weight", "err", "base").alias("rate"))
    return g.select(F.col("window.start").alias("start"), group, "n", "rate", S.tier(F.col("rate")).alias("tier"))
