"""Contracts on inputs: each costs one aggregate job and fails with what it found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    pass


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    if gone := sorted(set(names) - set(df.columns)):
        raise ContractError(f"missing columns: {gone}")
    return df


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    # Hashes of eight bytes are counted first; keys themselves only where a hash repeats.
    hashed = df.withColumn("_hash", F.xxhash64(*keys))
    same = hashed.groupBy("_hash").count().where("count > 1").select("_hash")
    if not same.head(1):
        return df
    twice = hashed.join(same, "_hash", "left_semi").groupBy(*keys).count().where("count > 1").limit(3).collect()
    if twice:
        raise ContractError(f"{keys} repeat: {twice}")
    return df


def require_all(df: DataFrame, **rules: Column) -> DataFrame:
    """Every rule must hold on every row; a null counts as broken."""
    broken = df.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()]).first()
    bad = {k: v for k, v in broken.asDict().items() if v}
    if bad:
        raise ContractError(f"rows against the rules: {bad}")
    return df


def differences(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, with the side."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return x.join(y, keys, "left_anti").withColumn("side", F.lit("left")).unionAll(y.join(x, keys, "left_anti").withColumn("side", F.lit("right")))


def require_same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> None:
    if found := differences(a, b, keys).limit(3).collect():
        raise ContractError(f"keys differ: {found}")


def require_content(df: DataFrame, expected: str) -> DataFrame:
    """Of binary files (path, content): all bytes must have the expected SHA-256."""
    wrong = df.where(F.sha2("content", 256) != expected).select("path").limit(3).collect()
    if wrong:
        raise ContractError(f"unexpected content: {wrong}")
    return df


def drift_inputs(df: DataFrame, delta: str, sd: str) -> DataFrame:
    """``df`` if it has two rows at least, finite changes, and finite standard deviations of zero or more."""
    if len(df.take(2)) < 2:
        raise ContractError("at least two jurisdictions are required")
    finite = lambda x: F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return require_all(df, finite_change=finite(delta), finite_deviation=finite(sd) & (F.col(sd) >= 0))
