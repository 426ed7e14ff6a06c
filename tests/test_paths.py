"""Factors, curves, walks and publications against plain versions."""

import json
import os

import numpy as np
import pytest

from caselens.functions import curves, linear
from caselens.operators import persistence as M
from caselens.operators import solver
from caselens.sources.publication import Publication
from pyspark.sql import functions as F


def test_factor_and_solve_equal_numpy(spark):
    rng = np.random.default_rng(1)
    rows = []
    for n in (1, 2, 4, 7):
        a = rng.normal(size=(n, n))
        rows.append(((a @ a.T + n * np.eye(n)).tolist(), rng.normal(size=n).tolist()))
    df = spark.createDataFrame(rows, "a array<array<double>>, b array<double>").withColumn("l", linear.cholesky(F.col("a")))
    for r in df.withColumn("y", linear.forward(F.col("l"), F.col("b"))).collect():
        want = np.linalg.cholesky(np.array(r.a))
        assert [len(x) for x in r.l] == list(range(1, len(want) + 1))
        assert np.allclose(np.concatenate(r.l), want[np.tril_indices(len(want))]) and np.allclose(r.y, np.linalg.solve(want, r.b))


def test_conditional_law_equals_solve(spark):
    rng = np.random.default_rng(2)
    years = list(range(1995, 2001))
    rows = [(f"g{g}", g, t, float(v), float(s)) for g in range(5) for t, v, s in zip(years, rng.normal(8, 2, 6), rng.random(6) + 0.1, strict=True)]
    df = spark.createDataFrame(rows, "grp string, grp_no int, period int, rate double, v double")
    fit = spark.createDataFrame([(0.6, 2.0, 1.5)], "rho double, fixed double, drifting double")
    got = {r.grp: r for r in M.conditional_law(M.histories(df, 2000), fit, [2001, 2002, 2003]).collect()}
    rate = np.array([r[3] for r in rows]).reshape(5, 6)
    x = rate - rate.mean(0)
    t, h = np.array(years, float), np.array([2001.0, 2002.0, 2003.0])
    law = lambda a, b: 2.0 + 1.5 * 0.6 ** np.abs(a[:, None] - b[None])
    for g in range(5):
        cov = law(t, t) + np.diag([r[4] for r in rows[6 * g : 6 * g + 6]])
        cross = law(h, t)
        r = got[f"g{g}"]
        assert np.allclose(r["mean"], cross @ np.linalg.solve(cov, x[g]))
        left = law(h, h) - cross @ np.linalg.solve(cov, cross.T) + 1e-9 * np.eye(3)
        assert np.allclose(np.concatenate(r.factor), np.linalg.cholesky(left)[np.tril_indices(3)])
    anchors = df.select("grp", (F.col("grp_no") + 5).cast("long").alias("seed"), F.lit(9.0).alias("anchor")).distinct()
    paths = M.exposure(M.conditional_law(M.histories(df, 2000), fit, [2001, 2002, 2003]), anchors, [2001, 2002, 2003], 400)
    seen = {(r.grp, r.year): r for r in paths.groupBy("grp", "year").agg(F.avg("unclipped").alias("m"), F.var_pop("unclipped").alias("v"), F.count("*").alias("n"), F.min("rate").alias("low")).collect()}
    for (g, year), r in seen.items():
        one = got[g]
        k = year - 2001
        want = 9 + one["mean"][k] - one["mean"][0]
        spread = sum(v * v for v in one.factor[k]) + one.v[-1]
        assert r.n == 400 and r.low >= 0 and abs(r.m - want) < 5 * (spread / 400) ** 0.5 and r.v == pytest.approx(spread, rel=0.35)


def test_curve_and_inverse_compose_to_the_identity(spark):
    x, y = [0.0, 0.2, 0.2, 0.5, 0.5, 0.5, 0.9, 1.0], [0.0, 0.1, 0.3, 0.35, 0.4, 0.6, 0.8, 1.0]
    df = spark.createDataFrame([(x, y)], "x array<double>, y array<double>").withColumn("k", curves.collapsed(F.col("x"), F.col("y")))
    knots = [(r.x, r.y) for r in df.first().k]
    assert knots == [(0.0, 0.0), (0.2, 0.3), (0.5, 0.6), (0.9, 0.8), (1.0, 1.0)]
    at = [i / 40 for i in range(-2, 43)]
    rows = df.withColumn("at", F.explode(F.array(*[F.lit(v) for v in at])))
    got = rows.select("at", curves.interpolated(F.col("at"), F.col("k")).alias("f"), curves.interpolated(curves.interpolated(F.col("at"), F.col("k")), curves.turned(F.col("k"))).alias("back")).collect()
    assert [r.f for r in got] == pytest.approx(list(np.interp(at, *zip(*knots, strict=True))))
    assert [r.back for r in got] == pytest.approx([min(max(v, 0), 1) for v in at])
    assert df.select(curves.rising(F.array(F.lit(0.1), F.lit(0.4), F.lit(0.3), F.lit(0.5))).alias("r")).first().r == [0.1, 0.4, 0.4, 0.5]


def test_one_knot(spark):
    df = spark.createDataFrame([([0.5], [2.0])], "x array<double>, y array<double>")
    assert df.select(curves.interpolated(F.lit(0.7), curves.collapsed(F.col("x"), F.col("y"))).alias("f")).first().f == 2.0


def test_walk_ends_for_each_reason(spark):
    rows = [("matched", 300.0, 190.0), ("matched", 300.0, 162.0), ("matched", 40.0, 365.0), ("empty", 30.0, 500.0), ("not solved", 5000.0, 300.0), ("passed", 101.0, 170.0)]
    df = spark.createDataFrame(rows, "want string, income double, target double")
    # Falls by 0.5 a dollar, but by 90 at an income of 100: from above to below the target in one step.
    value = lambda x: 400 - 0.5 * x - (90.0 if x > 100 else 0.0)
    paid = lambda x, given: 400 - 0.5 * x - np.where(x > 100, 90.0, 0.0) + given["zero"]
    recorded = 400 - 0.5 * F.col("income") - F.when(F.col("income") > 100, 90.0).otherwise(0.0)
    rows = df.withColumn("recorded", recorded).withColumn("target", F.when(F.col("want") == "passed", F.col("recorded") + 30).otherwise(F.col("target"))).withColumn("zero", F.lit(0))
    rows = rows.withColumn("id", F.concat_ws("|", "want", "income", "target")).unionByName(spark.sql("SELECT 'not solved' AS want, 1.0D AS income, CAST(NULL AS DOUBLE) AS target, 2.0D AS recorded, 0 AS zero, 'none' AS id"))
    got = {r.id: r for r in solver.walk(rows, "id", "income", "target", "recorded", ["zero"], paid, most=200).collect()}
    assert (got["none"].steps, got["none"].income, got["none"].reached, got["none"].reason) == (0, None, None, "not solved")
    for r in rows.where("target IS NOT NULL").collect():
        income, steps, up = r.income, 0, r.target > r.recorded
        while steps < 200:
            now = value(income)
            if abs(r.target - now) <= 3 or (now > r.target if up else now < r.target) or (income <= 0 if up else now <= 0):
                break
            income, steps = (max(income - 3, 0) if up else income + 3), steps + 1
        w = got[r.id]
        assert (w.steps, w.income, w.reached) == (steps, income, value(income)) and w.reason == r.want, r


def test_array_chain_equals_the_column_chain(spark):
    from caselens.functions import scalars as S

    df = spark.range(300).select((F.col("id") * 37.3 % 2600).alias("g"), (F.col("id") * 11.7 % 900).alias("e"), (F.col("id") % 6 + 1).alias("n"), (F.col("id") * 53.1 % 1500).alias("h"))
    df = df.withColumn("most", (200 + 160 * F.col("n")).cast("double"))
    rows = df.withColumn("b", S.benefit(F.col("g"), F.col("e"), F.col("n"), F.col("h"), most=F.col("most"), least=F.lit(23.0))["benefit"]).collect()
    g, e, n, h, most, b = (np.array([r[i] for r in rows], float) for i in range(6))
    assert S.benefits(g, e, n, h, most, 23.0).tolist() == b.tolist() and len(set(b.tolist())) > 50


def test_publication_is_whole_or_not_at_all(spark, tmp_path):
    shop = Publication(spark, f"file://{tmp_path}/out")
    with pytest.raises(FileNotFoundError):
        shop.read("a")
    a, b = spark.range(10).repartition(3), spark.range(5).selectExpr("id * 2 AS id")
    first = shop.publish({"a": a, "b": b})
    assert shop.current() == first and shop.read("a").count() == 10
    manifest = json.loads((tmp_path / "out" / "sets" / first / "MANIFEST.json").read_text())
    assert {f["artifact"] for f in manifest} == {"a", "b"} and all(os.path.getsize(tmp_path / "out" / "sets" / first / f["artifact"] / f["file"]) == f["size"] and len(f["sha256"]) == 64 for f in manifest)
    # A run that stops between two artifacts leaves the old set whole.
    broken = spark.range(3).selectExpr("assert_true(id < 2, 'stop') AS x", "id")
    with pytest.raises(Exception, match="stop"):
        shop.stage({"a": spark.range(99), "b": broken})
    assert shop.current() == first and (shop.read("a").count(), shop.read("b").count()) == (10, 5)
    # One that stops before the pointer is renamed, too.
    staged = shop.stage({"a": spark.range(7), "b": b})
    assert shop.read("a").count() == 10
    shop.switch(staged)
    assert shop.current() == staged and shop.read("a").count() == 7
    assert len(shop.clear_staged()) == 2 and shop.read("b").count() == 5 and shop.clear_staged() == []
    # Files that changed after staging aren't published.
    odd = shop.stage({"a": spark.range(4)})
    part = next(p for p in (tmp_path / "out" / "sets" / odd / "a").iterdir() if p.suffix == ".parquet")
    part.write_bytes(part.read_bytes() + b"x")
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError, match="manifest"):
        shop.switch(odd)
    assert shop.current() == staged
