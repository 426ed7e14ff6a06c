"""Small dense linear algebra over array columns: factors and solves of a row's own matrix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cholesky(matrix: Column) -> Column:
    """The lower factor of a positive definite matrix, row i with i + 1 entries."""

    def row(factor: Column, i: Column) -> Column:
        a = F.get(matrix, i)

        def put(r: Column, j: Column) -> Column:
            other = F.when(j == i, r).otherwise(F.slice(F.get(factor, j), 1, F.greatest(j, F.lit(0))))
            rest = F.get(a, j) - dot(r, other)
            return F.concat(r, F.array(F.when(j == i, F.sqrt(rest)).otherwise(rest / F.get(F.get(factor, j), j))))

        return F.aggregate(F.sequence(F.lit(0), i), F.array().cast("array<double>"), put)

    return F.aggregate(F.sequence(F.lit(0), F.size(matrix) - 1), F.array().cast("array<array<double>>"), lambda f, i: F.concat(f, F.array(row(f, i))))


def forward(factor: Column, right: Column) -> Column:
    """The solution y of factor * y = right, from the first row on."""

    def put(y: Column, i: Column) -> Column:
        r = F.get(factor, i)
        return F.concat(y, F.array((F.get(right, i) - dot(y, F.slice(r, 1, i))) / F.get(r, i)))

    return F.aggregate(F.sequence(F.lit(0), F.size(factor) - 1), F.array().cast("array<double>"), put)
