import math

import pytest
from pyspark.sql import functions as F

from caselens.functions import quantiles as Q
from caselens.functions import rng
from caselens.functions import scalars as S


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_tiers_are_half_open(spark):
    rates = [5.99, 6.0, 7.99, 8.0, 9.99, 10.0, 24.66]
    assert values(spark, S.tier(F.col("r")), [(r,) for r in rates], "r double") == [0, 5, 5, 10, 10, 15, 15]
    with pytest.raises(Exception, match="finite"):
        values(spark, S.valid_tier(F.col("r")), [(-1.0,)], "r double")


def test_lever(spark):
    e = [(100.0, [365, 311]), (100.0, [365, 365]), (100.0, [311]), (0.0, [365]), (100.0, [])]
    full = S.lever_error(F.col("e"), F.col("x"), [365], 1.0)
    assert values(spark, full, e, "e double, x array<int>") == [50, 0, 100, 0, 100]
    assert values(spark, S.lever_error(F.col("e"), F.col("x"), [365], 0.5), e[:1], "e double, x array<int>") == [75]
    with pytest.raises(ValueError):
        S.targeted_error(F.col("e"), F.col("e") > 0, 1.5)


def test_delay_form(spark):
    assert values(spark, S.delays(F.col("r")), [(13.33,), (13.34,)], "r double") == [False, True]


def test_rounding_family(spark):
    rows = [(2.5,), (-2.5,), (0.5,), (-0.2,)]
    assert values(spark, S.half_away(F.col("x")), rows, "x double") == [3, -3, 1, 0]
    assert values(spark, S.half_up(F.col("x")), rows, "x double") == [3, -2, 1, 0]
    assert values(spark, S.half_even(F.col("x")), rows, "x double") == [2.0, -2.0, 0.0, 0.0]
    assert values(spark, S.significant(F.col("x"), 3), [(0.0,), (123456.0,), (-0.0012345,)], "x double") == [0.0, 123000.0, pytest.approx(-0.00123)]


def test_text_and_missing(spark):
    assert values(spark, S.parsed_number(F.col("t")), [("",), (" . ",), ("4.5",), (None,)], "t string") == [None, None, 4.5, None]
    with pytest.raises(Exception):
        values(spark, S.parsed_number(F.col("t")), [("x1",)], "t string")
    assert values(spark, S.nonnegative(F.col("x")), [(-9.0,), (0.0,), (None,)], "x double") == [None, 0.0, None]
    two = "a double, b double"
    assert values(spark, S.row_sum([F.col("a"), F.col("b")]), [(None, None), (1.0, None), (1.0, 2.0)], two) == [None, 1.0, 3.0]


def test_months(spark):
    assert values(spark, S.months_back(F.col("y"), F.lit(3)), [(202001,), (202012,)], "y int") == [201910, 202009]
    assert values(spark, S.fiscal_year(F.col("y")), [(201909,), (201910,)], "y int") == [2019, 2020]


def test_counter_stream_is_random_access(spark):
    def plain(seed, n):
        out, a = [], seed
        for _ in range(n):
            a = (a + 0x6D2B79F5) & 0xFFFFFFFF
            t = ((a ^ a >> 15) * (a | 1)) & 0xFFFFFFFF
            t ^= (t + ((t ^ t >> 7) * (t | 61) & 0xFFFFFFFF)) & 0xFFFFFFFF
            out.append((t ^ t >> 14) / 2**32)
        return out

    df = spark.range(1, 3001).select(rng.uniform(F.lit(11).cast("long"), F.col("id")))
    got = [r[0] for r in df.collect()]
    assert got == plain(11, 3000)
    assert got[:3] == [0.5115870486479253, 0.5299464082345366, 0.6081185641232878]
    assert spark.range(1).select(rng.uniform(F.lit(1107).cast("long"), F.lit(1).cast("long"))).first()[0] == 0.03414323343895376


STEPS = [3.0, 3.4, 4.1, 5.0, 5.8, 6.6, 7.1, 7.6, 8.2]


def test_quantiles(spark):
    q = F.array(*[F.lit(s) for s in STEPS])
    one = spark.range(1)
    at = lambda c: one.select(c).first()[0]
    for level, s in zip(Q.LEVELS, STEPS, strict=True):
        assert at(Q.survival(F.lit(math.exp(s)) * (1 + 1e-12), q, F.lit(0.4))) == pytest.approx(1 - level, abs=1e-6)
        assert at(Q.inverse(F.lit(level), q, F.lit(0.4))) == pytest.approx(s, abs=1e-9)
    assert at(Q.survival(F.lit(math.exp(8.2) * 2**0.4), q, F.lit(0.4))) == pytest.approx(0.005)
    assert at(Q.survival(F.lit(1.0), q, F.lit(0.4))) == 1
    low = at(Q.monotone(F.array(F.lit(math.log(4)), F.lit(math.log(0.1)), F.lit(math.log(2))), 0.5))
    assert [math.exp(x) for x in low] == pytest.approx([0.5, 2, 4])


def test_expected_error_agrees_with_simulation(spark):
    q = F.array(*[F.lit(s) for s in STEPS])
    exact = spark.range(1).select(Q.expected_above(F.lit(500.0), q, F.lit(0.4), F.lit(5000.0))).first()[0]
    size = F.least(F.exp(Q.inverse((F.col("id") + 0.5) / 200_000, q, F.lit(0.4))), F.lit(5000.0))
    drawn = spark.range(200_000).select(F.avg(F.when(size > 500, size).otherwise(0.0))).first()[0]
    assert exact == pytest.approx(drawn, rel=2e-3)
