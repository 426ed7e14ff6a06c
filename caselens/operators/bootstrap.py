"""Resampling with counter-based draws: any draw of any group is computed alone.

Draws of a fixed size pick cases by position. A group of at most TASK_ROWS rows
is ordered and drawn from in one task, as numbers in Arrow batches: the common
case, a jurisdiction's review sample of a period. Larger groups are measured
first and never gathered: their rows get places by ranges, their picks are made
from the counter in blocks of BLOCK occurrences by any task, counted by place,
and joined to the rows by (group, place). Both ways give the same draws.
:func:`poisson_sums` resamples groups of any size without places, and sums over
the population stay in ordinary aggregates.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rng
from ..sources.shared import store
from . import windows

#: Rows of a group that one task holds; the draws of larger groups are joined by place.
TASK_ROWS = 500_000
#: Occurrences that a row of the table of picks stands for before it is expanded.
BLOCK = 65_536


def samples(df: DataFrame, group: str, order: list[str], **values: Column) -> DataFrame:
    """A group's rows with what puts them in a fixed order (``_o0`` ...) and the values that draws use."""
    return df.select(group, *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], *[v.alias(k) for k, v in values.items()])


def per_draw(sampled: DataFrame, group: str, draws: int, sums: list[str], one: Callable, large: Callable) -> DataFrame:
    """(group, draw, sums): ``one(rows, draw)`` gives a draw's sums from a group's ordered rows;
    ``large(rows, sizes)`` gives (group, draw, sums) of the groups over TASK_ROWS from rows with ``_place``
    (from 0) and their sizes (group, n)."""
    order = [c for c in sampled.columns if c.startswith("_o")]
    kind = sampled.schema[group].dataType.simpleString()

    def run(frame):
        import pandas as pd

        rows = frame.sort_values(order, kind="stable")
        out = [(rows[group].iloc[0], d, *one(rows, d)) for d in range(draws)]
        return pd.DataFrame(out, columns=[group, "draw", *sums])

    schema = f"{group} {kind}, draw int, {', '.join(f'{s} double' for s in sums)}"
    kept = store(sampled, "samples")
    sizes = store(kept.groupBy(group).agg(F.count("*").alias("n")), "sizes")
    if not sizes.where(F.col("n") > TASK_ROWS).head(1):
        return kept.groupBy(group).applyInPandas(run, schema)
    wide = sizes.where(F.col("n") > TASK_ROWS)
    ranked = windows.places(kept.join(wide.select(group), group, "left_semi"), [group], [F.asc(o) for o in order], "_place")
    rest = kept.join(wide.select(group), group, "left_anti").groupBy(group).applyInPandas(run, schema)
    joined = large(ranked.withColumn("_place", F.col("_place") - 1).drop(*order), wide)
    return rest.unionByName(joined.select(group, F.col("draw").cast("int").alias("draw"), *[F.col(s).cast("double").alias(s) for s in sums]))


def occurrences(sizes: DataFrame, group: str, draws: int, seed: int, *, extra: int = 0, uniforms: int = 1) -> DataFrame:
    """(group, draw, _place, u1, ...): every pick of every draw of groups of any size, and the further
    uniforms that an occurrence has. Blocks of occurrences are dealt out before they are expanded."""
    m = F.col("n") + extra
    blocks = sizes.select(group, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((m * draws - 1) / BLOCK))).alias("_block"))
    dealt = blocks.repartition(F.col(group), F.col("_block"))
    last = F.least(m * draws, (F.col("_block") + 1) * BLOCK) - 1
    each = dealt.select(group, "n", F.explode(F.sequence(F.col("_block") * BLOCK, last)).alias("_at"))
    u = [rng.uniform(F.lit(seed).cast("long"), F.col("_at") * uniforms + t + 1) for t in range(uniforms)]
    return each.select(group, F.floor(F.col("_at") / m).alias("draw"), F.floor(u[0] * F.col("n")).alias("_place"), *[x.alias(f"u{t + 1}") for t, x in enumerate(u[1:])])


def _summed(rows: DataFrame, picks: DataFrame, group: str, sums: list[str]) -> DataFrame:
    """Picks counted by place and draw, joined to the rows they pick."""
    counted = picks.groupBy(group, "_place", "draw").agg(F.count("*").alias("_times"))
    joined = counted.join(rows, [group, "_place"])
    return joined.groupBy(group, "draw").agg(*[F.sum(F.col("_times") * F.col(s)).alias(s) for s in sums])


def draw_sums(sampled: DataFrame, group: str, draws: int, seed: int, sums: list[str], *, extra: int = 0) -> DataFrame:
    """(group, draw, sums): each draw resamples n + extra rows uniformly and sums the fields.

    Every group uses the same stream, read from its own position on: draw d's
    j-th pick is the uniform of index d * m + j + 1, whatever task computes it.
    """

    def one(rows, d: int) -> list[float]:
        import numpy as np

        n, m = len(rows), len(rows) + extra
        at = (rng.uniforms(seed, d * m + np.arange(1, m + 1)) * n).astype(np.int64)
        return [float(rows[s].to_numpy()[at].sum()) for s in sums]

    large = lambda rows, sizes: _summed(rows, occurrences(sizes, group, draws, seed, extra=extra), group, sums)
    return per_draw(sampled, group, draws, sums, one, large)


def seeded_sums(sampled: DataFrame, group: str, draws: int, seeds: list[int], sums: list[str]) -> DataFrame:
    """(group, seed, draw, sums): as :func:`draw_sums` from several streams of their own; a group's rows are ordered once for all of them."""

    def one(rows, k: int) -> list[float]:
        import numpy as np

        n, (s, d) = len(rows), divmod(k, draws)
        at = (rng.uniforms(seeds[s], d * n + np.arange(1, n + 1)) * n).astype(np.int64)
        return [float(rows[x].to_numpy()[at].sum()) for x in sums]

    def large(rows: DataFrame, sizes: DataFrame) -> DataFrame:
        streams = [occurrences(sizes, group, draws, seed).withColumn("draw", F.col("draw") + s * draws) for s, seed in enumerate(seeds)]
        return _summed(rows, functools.reduce(DataFrame.unionByName, streams), group, sums)

    out = per_draw(sampled, group, draws * len(seeds), sums, one, large)
    of = F.element_at(F.array(*[F.lit(s) for s in seeds]), F.floor(F.col("draw") / draws).cast("int") + 1)
    return out.select(group, of.alias("seed"), (F.col("draw") % draws).alias("draw"), *sums)


#: The Poisson distribution function of mean 1 at 0, 1, 2, ...
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)


def poisson_sums(df: DataFrame, groups: list[str], key: str, draws: int, **sums: Column) -> DataFrame:
    """(groups, draw, sums): a bootstrap at population size.

    Each row enters draw d as often as a Poisson variable of mean 1, made from a hash of (d, key) alone,
    says: draws are sums with map-side combine, and no task gathers a group.
    """
    rows = df.select(*groups, key, *[v.alias(k) for k, v in sums.items()], F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    u = rng.hash_uniform(F.col("draw"), F.col(key))
    times = F.lit(len(POISSON))
    for k in range(len(POISSON) - 1, -1, -1):
        times = F.when(F.col("_u") < POISSON[k], F.lit(k)).otherwise(times)
    rows = rows.withColumn("_u", u).withColumn("_k", times.cast("double")).where("_k > 0")
    return rows.groupBy(*groups, "draw").agg(*[F.sum(F.col(k) * F.col("_k")).alias(k) for k in sums])


def recentred(draws: DataFrame, points: DataFrame, keys: list[str], official: str) -> DataFrame:
    """Additively: official + (point under the scenario - base point) + (draw - point under the scenario)."""
    moved = F.col(official) + (F.col("point1") - F.col("point0")) + (F.col("rate") - F.col("point1"))
    return draws.join(points, keys).withColumn("rate", moved)


def percentile_interval(draws: DataFrame, keys: list[str], x: str) -> DataFrame:
    return draws.groupBy(*keys).agg(F.stddev_samp(x).alias("se"), F.percentile(x, F.lit(0.025)).alias("low"), F.percentile(x, F.lit(0.975)).alias("high"))


def summary(draws: DataFrame, keys: list[str], x: str) -> DataFrame:
    """:func:`percentile_interval` with the share of draws at exactly zero."""
    zero = draws.groupBy(*keys).agg(F.avg((F.col(x) == 0).cast("double")).alias("zero_share"))
    return percentile_interval(draws, keys, x).join(zero, keys)


def over_seeds(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Mean over seeds and its Monte-Carlo standard error."""
    return df.groupBy(*keys).agg(F.avg(x).alias("mean"), (F.stddev_samp(x) / F.sqrt(F.count(x))).alias("mc_se"))
