"""Readers by format, with column pruning left to Spark."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S

CASE_COLUMNS = "STATE STRING, CASE STRING, STATUS STRING, HWGT STRING, RAWBEN STRING, AMTERR STRING"


def read_case_csv(spark: SparkSession, path: str, *, threshold: float, slots: int = 9) -> DataFrame:
    """The core universe of a case CSV: state known, CASE missing or 1, RAWBEN present, weight over 0."""
    names = [f"ELEMENT{i}" for i in range(1, slots + 1)]
    raw = spark.read.schema(", ".join([CASE_COLUMNS, *(f"{n} STRING" for n in names)])).csv(path, header=True)
    number = {c: S.parsed_number(F.col(c)) for c in ("CASE", "STATUS", "HWGT", "RAWBEN", "AMTERR")}
    elements = F.array_distinct(F.filter(F.array(*[S.parsed_number(F.col(n)).cast("int") for n in names]), lambda e: e.isNotNull()))
    rows = raw.select(F.col("STATE").alias("state"), number["CASE"].alias("kind"), number["STATUS"].alias("status"), F.coalesce(number["HWGT"], F.lit(0.0)).alias("weight"), number["RAWBEN"].alias("issuance"), F.coalesce(number["AMTERR"], F.lit(0.0)).alias("amount"), elements.alias("elements"))
    rows = rows.where("state IS NOT NULL AND (kind IS NULL OR kind = 1) AND issuance IS NOT NULL AND weight > 0")
    error = F.when(S.counted(F.col("status"), F.col("amount"), F.lit(threshold)), F.col("amount")).otherwise(0.0)
    return rows.select("state", "weight", "issuance", error.alias("error"), "elements")


def read_any(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Parquet, CSV or JSON lines, by the path's ending; only ``columns`` are read."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        df = spark.read.csv(path, header=True)
    elif kind in ("json", "jsonl"):
        df = spark.read.option("mode", "FAILFAST").json(path)
    elif kind == "parquet":
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"no reader for .{kind}")
    return df.select(*[F.col(c) for c in columns])


def read_by_period(spark: SparkSession, paths: dict[int, str], columns: list[str]) -> DataFrame:
    """Yearly files of drifting schemas as one table; columns that a year lacks are null."""
    years = []
    for period, path in sorted(paths.items()):
        df = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.csv(path, header=True)
        years.append(df.select(*[c for c in columns if c in df.columns]).withColumn("period", F.lit(period)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), years)


def parse_rate_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """(name, over, under, total) from the text lines of a published table; other lines are left out."""
    pattern = r"^\s*([A-Za-z_0-9][A-Za-z_0-9 .]*?)\s{2,}(-?\d+\.\d+)\s+(-?\d+\.\d+)\s+(-?\d+\.\d+)\s*$"
    part = lambda i: F.regexp_extract(F.col(column), pattern, i)
    found = lines.where(F.col(column).rlike(pattern))
    return found.select(part(1).alias("name"), *[part(i + 2).cast("double").alias(n) for i, n in enumerate(("over", "under", "total"))])


def unpivot_registry(wide: DataFrame, key: str, years: list[str]) -> DataFrame:
    """A wide registry (one column a year) as (key, period, value)."""
    return wide.unpivot([key], years, "period", "value").withColumn("period", F.col("period").cast("int"))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON objects, one a line; a line that is none fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def last_row_wins(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row of highest order per key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")
