"""Attribution of dollars to causes over repeated finding slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def codes(*slots: str) -> Column:
    """The distinct present codes of a case's slots."""
    return F.array_distinct(F.filter(F.array(*[F.col(s) for s in slots]), lambda c: c.isNotNull()))


def classes(codes_: Column) -> Column:
    """The distinct cause classes; a case without codes is unclassified."""
    found = F.array_distinct(F.transform(codes_, S.cause_class))
    return F.when(F.size(codes_) == 0, F.array(F.lit("unclassified"))).otherwise(found)


def fractional(df: DataFrame, keys: list[str], classes_: Column, weight: str, amount: str) -> DataFrame:
    """Each case's dollars in equal parts to its classes: parts add up to the dollars."""
    part = F.col(weight) * F.col(amount) / F.size("_classes")
    rows = df.withColumn("_classes", classes_).select(*keys, part.alias("_part"), F.explode("_classes").alias("cause"))
    return rows.groupBy(*keys, "cause").agg(F.sum("_part").alias("dollars"))


def exclusive_axis(classes_: Column) -> Column:
    agency, client = F.array_contains(classes_, "agency_or_system"), F.array_contains(classes_, "client_or_fact")
    return F.when(agency & client, "mixed").when(agency, "agency").when(client, "client").otherwise("residual")


def any_presence(df: DataFrame, keys: list[str], items: Column, name: str, weight: str, amount: str) -> DataFrame:
    """Dollars of cases that have an item at all; items overlap, so their dollars must not be added."""
    rows = df.select(*keys, (F.col(weight) * F.col(amount)).alias("_d"), F.explode(F.array_distinct(items)).alias(name))
    return rows.groupBy(*keys, name).agg(F.count("*").alias("n"), F.sum("_d").alias("dollars"))


def code_set_dollars(df: DataFrame, keys: list[str], codes_: Column, weight: str, amount: str) -> DataFrame:
    d = F.col(weight) * F.col(amount)
    has = lambda s: F.arrays_overlap(codes_, F.array(*[F.lit(c) for c in s]))
    return df.groupBy(*keys).agg(*[F.sum(F.when(has(s), d).otherwise(0.0)).alias(n) for n, s in S.CODE_SETS.items()])


def long_slots(df: DataFrame, keys: list[str], slots: list[dict[str, Column]]) -> DataFrame:
    """One row per filled slot: the wide slots' paired fields, with the slot's number."""
    items = F.array(*[F.struct(F.lit(i + 1).alias("slot"), *[c.alias(n) for n, c in s.items()]) for i, s in enumerate(slots)])
    return df.select(*keys, F.inline(items))


def nature(slots: Column) -> Column:
    """Four exclusive classes by whether all, some or none of the filled slots are flagged."""
    return F.when(F.size(slots) == 0, "none").when(F.forall(slots, lambda s: s), "all").when(F.exists(slots, lambda s: s), "some").otherwise("clear")


def overlap(df: DataFrame, keys: list[str], flags: dict[str, Column], dollars: Column) -> DataFrame:
    """Channels' dollars, their union, and the credit counted twice."""
    union = F.lit(False)
    for f in flags.values():
        union = union | f
    sums = [F.sum(F.when(f, dollars).otherwise(0.0)).alias(n) for n, f in flags.items()]
    g = df.groupBy(*keys).agg(*sums, F.sum(F.when(union, dollars).otherwise(0.0)).alias("any"))
    total = sum((F.col(n) for n in flags), F.lit(0.0))
    return g.withColumn("twice", total - F.col("any"))
