"""Deterministic exports of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def struct_of_arrays(df: DataFrame, group: str, order: list[str], **columns: Column) -> DataFrame:
    """A row per group with one array per column, all in the same order.

    For exports of a bounded number of rows per group: a group's arrays live in one row.
    """
    item = F.struct(*order, *[c.alias(n) for n, c in columns.items()])
    rows = df.groupBy(group).agg(F.sort_array(F.collect_list(item)).alias("_rows"))
    pick = lambda n: F.transform("_rows", lambda r: r[n]).alias(n)
    return rows.select(group, *[pick(n) for n in columns])


def bitset(flags: Column) -> Column:
    """Base64 of the flags' bits, the first in the lowest bit of the first byte."""
    n = F.size(flags)
    byte = lambda i: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0), lambda a, j: a + F.when(F.coalesce(F.get(flags, i * 8 + j), F.lit(False)), F.shiftleft(F.lit(1), 0) * F.pow(F.lit(2), j).cast("int")).otherwise(0))
    hexes = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / 8).cast("int") - 1, F.lit(0))), lambda i: F.lpad(F.hex(byte(i)), 2, "0"))
    return F.when(n == 0, F.lit("")).otherwise(F.base64(F.unhex(F.array_join(hexes, ""))))


def sized(fine: Column, coarse: Column, most: int) -> Column:
    """The fine encoding where it fits the budget of bytes, else the coarse one."""
    return F.when(F.octet_length(fine) <= most, fine).otherwise(coarse)


def canonical_digest(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """SHA-256 of 'key=value' lines in key order: the same whatever the rows' order."""
    line = F.concat(F.concat_ws("|", *keys), F.lit("="), F.col(value).cast("string"))
    return df.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("sha256"))


def write_parquet(df: DataFrame, path: str, order: list[str]) -> None:
    df.sortWithinPartitions(*order).write.mode("errorifexists").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").csv(path, header=True)


def sparse_patch(base: DataFrame, changed: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The keys whose value differs, with the new value."""
    new = changed.select(*keys, F.col(value).alias("_new"))
    return base.join(new, keys).where(~F.col(value).eqNullSafe(F.col("_new"))).select(*keys, F.col("_new").alias(value))


def apply_patch(base: DataFrame, patch: DataFrame, keys: list[str], value: str) -> DataFrame:
    new = patch.select(*keys, F.col(value).alias("_new"), F.lit(True).alias("_hit"))
    rows = base.join(new, keys, "left")
    return rows.withColumn(value, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(value))).drop("_new", "_hit")
