import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselens.functions import scalars as S
from caselens.operators import attribution as A
from caselens.operators import bootstrap as B
from caselens.operators import impute as I
from caselens.operators import panel as P
from caselens.operators import rates as R
from caselens.operators import windows as X
from caselens.sources import contracts, readers, writers


def test_draw_summary(spark):
    draws = spark.createDataFrame([("s", r) for r in (9.5, 9.5, 10.5, 10.5)], "g string, rate double")
    r = R.draw_summary(draws, ["g"], "rate", F.lit(1e9)).first()
    assert (r.p10, r.p15, r.mean_bill) == (0.5, 0.5, 1.25e8) and r.sd_bill == pytest.approx(2.5e7)


def test_rollup_total(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0, 100.0), ("a", 2.0, 0.0, 50.0), ("b", 1.0, 10.0, 100.0)], "g string, w double, e double, b double")
    got = {r.g: r.rate for r in R.with_total(df, "g", "ALL", R.weighted_ratio("w", "e", "b").alias("rate")).collect()}
    assert got == {"a": 2.5, "b": 10.0, "ALL": 5.0}


def test_fractional_attribution_exhausts_dollars(spark):
    rows = [(1, 1.0, 200.0, 17, None), (2, 2.0, 120.0, 17, 1), (3, 1.0, 60.0, 3, None), (4, 1.0, 280.0, None, None)]
    df = spark.createDataFrame(rows, "id int, w double, e double, a1 int, a2 int")
    c = A.codes("a1", "a2")
    got = {r.cause: r.dollars for r in A.fractional(df, [], A.classes(c), "w", "e").collect()}
    assert got == {"agency_or_system": 320, "client_or_fact": 180, "unclassified": 280}
    axis = {r.axis: r.d for r in df.groupBy(A.exclusive_axis(A.classes(c)).alias("axis")).agg(F.sum(F.col("w") * F.col("e")).alias("d")).collect()}
    assert axis == {"agency": 200, "mixed": 240, "client": 60, "residual": 280}
    any_ = {r.cause: r.dollars for r in A.any_presence(df, [], A.classes(c), "cause", "w", "e").collect()}
    assert any_["agency_or_system"] == 440 and any_["client_or_fact"] == 300


def test_budget_splits_one_row(spark):
    df = spark.createDataFrame([(i, float(s), 1.0) for i, s in enumerate([5, 9, 9, 1])], "id int, s double, w double")
    got = {r.id: r.membership for r in X.budget_membership(df, [], "s", ["id"], "w", 0.375).collect()}
    assert got == {1: 1.0, 2: 0.5, 0: 0.0, 3: 0.0}


def test_weighted_quantile_needs_no_interpolation(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 2.0)], "x double, w double")
    got = {r.level: r.value for r in X.weighted_quantiles(df, [], "x", "w", [0.25, 0.5, 0.51, 1.0]).collect()}
    assert got == {0.25: 1.0, 0.5: 2.0, 0.51: 3.0, 1.0: 3.0}


def test_auc_with_ties(spark):
    rng = np.random.default_rng(0)
    rows = [("g", float(rng.integers(0, 5)), float(rng.integers(0, 2)), float(rng.integers(1, 4))) for _ in range(80)]
    got = X.ranking_metrics(spark.createDataFrame(rows, "g string, s double, y double, w double"), ["g"], "s", "y", "w").first()
    pos, neg = [r for r in rows if r[2]], [r for r in rows if not r[2]]
    pairs = sum(p[3] * n[3] * ((p[1] > n[1]) + 0.5 * (p[1] == n[1])) for p in pos for n in neg)
    assert got.auc == pytest.approx(pairs / (sum(p[3] for p in pos) * sum(n[3] for n in neg)))


def test_ranged_running_sum_equals_plain(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([("g", int(i), float(x), 1.0) for i, x in enumerate(rng.random(300))], "g string, id int, x double, w double")
    order = [F.asc("x"), F.asc("id")]
    plain = X.running_before(df, ["g"], order, "w", "b").select("id", "b").collect()
    cut = X.running_before(df, ["g"], order, "w", "b", coarse=F.floor(F.col("x") * 10)).select("id", "b").collect()
    assert sorted(plain) == sorted(cut)


def test_bootstrap_is_deterministic_and_centred(spark):
    df = spark.createDataFrame([("s", i, float(i % 3), 10.0) for i in range(60)], "g string, id int, e double, b double")
    s = B.samples(df, "g", ["id"], e=F.col("e"), b=F.col("b"))
    draw = lambda d: B.draw_sums(d, "g", 200, 11, ["e", "b"]).select("draw", (F.col("e") * 100 / F.col("b")).alias("rate"))
    a = draw(s).collect()
    assert sorted(a) == sorted(draw(B.samples(df.repartition(5), "g", ["id"], e=F.col("e"), b=F.col("b"))).collect())
    assert np.mean([r.rate for r in a]) == pytest.approx(10, abs=0.3) and 0.5 < np.std([r.rate for r in a]) < 2
    wide = np.std([r[0] for r in B.draw_sums(s, "g", 200, 11, ["e", "b"], extra=180).select(F.col("e") * 100 / F.col("b")).collect()])
    assert wide < np.std([r.rate for r in a])


def test_groups_of_any_size_give_the_same_draws(spark, monkeypatch):
    """One group holds nine rows of ten; joined by place its draws equal those made in one task."""
    df = spark.createDataFrame([("hot" if i % 10 else "s", f"k{i // 2}", i, float(i % 7), 1.0 + i % 3) for i in range(900)], "g string, a string, id int, e double, b double")
    s = B.samples(df, "g", ["a", "id"], e=F.col("e"), b=F.col("b"))
    runs = [lambda: B.draw_sums(s, "g", 7, 11, ["e", "b"], extra=5), lambda: B.seeded_sums(s, "g", 3, [5, 77], ["e", "b"])]
    whole = [sorted(r().collect()) for r in runs]
    monkeypatch.setattr(B, "TASK_ROWS", 100)
    monkeypatch.setattr(B, "BLOCK", 64)
    for run, want in zip(runs, whole, strict=True):
        assert sorted(run().collect()) == want
    assert B.draw_sums(s.where("false"), "g", 7, 11, ["e"]).count() == 0


def test_planted_effect_is_recovered(spark):
    rows = [(g, y, 5 + i + 0.3 * (y - 1995) * (i % 2) + (2.0 if g == "T" and y >= 1998 else 0.0)) for i, g in enumerate(["T", "A", "B", "C", "D"]) for y in range(1993, 2001)]
    rows = [(g, y, 6.5 + 0.15 * (y - 1995) + (2.0 if y >= 1998 else 0.0)) if g == "T" else (g, y, x) for g, y, x in rows]
    df = spark.createDataFrame(rows, "grp string, period int, over double")
    pre, post = list(range(1993, 1998)), [1998, 1999, 2000]
    e = P.gap_effects(P.synthetic_controls(df, "grp", "period", ["over"], ["T", "A", "B", "C", "D"], pre), pre, post)
    own = e.where("unit = 'T'").first()
    assert own.effect == pytest.approx(2.0, abs=0.05) and own.rmspe < 0.05
    assert P.placebo_p(e, "T").first().p <= 1.0
    assert P.simplex(np.array([0.4, 0.9, -1.0])) == pytest.approx([0.25, 0.75, 0.0])


def test_raking_meets_margins(spark):
    df = spark.createDataFrame([(float(1 + i % 4), i % 2, float(i % 5)) for i in range(100)], "w double, k int, x double")
    raked, _ = I.rake(df, "w", {"all": (F.lit(1.0), 260.0), "k": (F.col("k").cast("double"), 160.0), "x": (F.col("x"), 500.0)})
    r = raked.agg(F.sum("raked"), F.sum(F.col("raked") * F.col("k")), F.sum(F.col("raked") * F.col("x"))).first()
    assert list(r) == pytest.approx([260, 160, 500], rel=1e-6)
    p = spark.createDataFrame([(float(i) / 10 - 5, 1.0) for i in range(100)], "l double, w double")
    s = I.intercept_shift(p, "l", "w", 0.2)
    assert p.agg(F.avg(1 / (1 + F.exp(-(F.col("l") + s))))).first()[0] == pytest.approx(0.2, abs=1e-8)


def test_hot_deck_falls_back(spark):
    donors = spark.createDataFrame([("d1", "a", 1, 1.0, 7), ("d2", "a", 1, 3.0, 8), ("d3", "b", 2, 1.0, 9)], "id string, g string, l int, w double, v int")
    rec = spark.createDataFrame([("r1", "a", 1), ("r2", "c", 2), ("r3", "c", 9)], "id string, g string, l int")
    got = {r.id: (r.level, r.imputed) for r in I.hot_deck(rec, donors, "id", [["g", "l"], ["l"], []], "w", "v", "s").collect()}
    assert got["r1"][0] == 0 and got["r1"][1] in (7, 8) and got["r2"] == (1, 9) and got["r3"][0] == 2


def test_variance_components(spark):
    rho, a, b = 0.7, 2.0, 3.0
    rows = [(k, 100, a + b * rho**k + (1.0 if k == 0 else 0.0)) for k in range(5)]
    fit = P.persistence_fit(spark.createDataFrame(rows, "lag int, n long, product double"), spark.createDataFrame([(1.0,)], "noise double")).first()
    assert fit.rho == pytest.approx(rho) and fit.fixed == pytest.approx(a, abs=1e-6) and fit.drifting == pytest.approx(b, abs=1e-6)


def test_contracts(spark):
    df = spark.createDataFrame([(1, 2.0), (1, None)], "k int, x double")
    with pytest.raises(contracts.ContractError):
        contracts.require_unique(df, ["k"])
    with pytest.raises(contracts.ContractError):
        contracts.require_all(df, present=F.col("x").isNotNull())
    with pytest.raises(contracts.ContractError):
        contracts.require_columns(df, ["k", "z"])
    with pytest.raises(contracts.ContractError):
        contracts.require_same_keys(df, df.where("k > 1"), ["k"])


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "c.csv").write_text("STATE,CASE,STATUS,HWGT,RAWBEN,AMTERR,ELEMENT1,ELEMENT2\nOR,1,2,1.5,300,60,365,365\nOR,,3,2,200,37,311,.\nOR,2,2,1,1,99,,\nOR,1,2,0,5,99,,\nOR,1,2,1,.,99,,\n")
    got = readers.read_case_csv(spark, str(tmp_path / "c.csv"), threshold=37, slots=2).orderBy("weight").collect()
    assert [(r.weight, r.error, r.elements) for r in got] == [(1.5, 60.0, [365]), (2.0, 0.0, [311])]
    (tmp_path / "j.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert readers.read_json_lines(spark, str(tmp_path / "j.jsonl"), "a int").agg(F.sum("a")).first()[0] == 3
    df = spark.createDataFrame([("b", 2), ("a", 1)], "k string, v int")
    assert writers.canonical_digest(df, ["k"], "v").first() == writers.canonical_digest(df.orderBy("k"), ["k"], "v").first()
    writers.write_parquet(df, str(tmp_path / "p.parquet"), ["k"])
    writers.write_csv(df, str(tmp_path / "q.csv"))
    assert readers.read_any(spark, str(tmp_path / "p.parquet"), ["k"]).count() == readers.read_any(spark, str(tmp_path / "q.csv"), ["k"]).count() == 2
    bits = spark.createDataFrame([([True, False, True] + [False] * 6 + [True],), ([],)], "f array<boolean>").select(writers.bitset(F.col("f")))
    import base64

    assert [base64.b64decode(r[0]) for r in bits.collect()] == [bytes([5, 2]), b""]
    for good in (True, False):
        blob = spark.read.format("binaryFile").load(str(tmp_path / "j.jsonl"))
        import hashlib

        want = hashlib.sha256((tmp_path / "j.jsonl").read_bytes()).hexdigest() if good else "0"
        if good:
            contracts.require_content(blob, want)
        else:
            with pytest.raises(contracts.ContractError):
                contracts.require_content(blob, want)


def test_streamed_rates(spark, tmp_path):
    from caselens.streaming.rates import rates_by_window

    rows = [("2020-01-01 00:00:10", "g", 1.0, 7.0, 100.0), ("2020-01-01 00:00:20", "g", 1.0, 5.0, 100.0), ("2020-01-01 00:05:00", "g", 1.0, 1.0, 100.0)]
    df = spark.createDataFrame(rows, "t string, g string, weight double, err double, base double").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = rates_by_window(stream, "t", "1 minute", "1 minute", "g").writeStream.format("memory").queryName("rates").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.n, r.rate, r.tier) for r in spark.table("rates").collect()] == [(2, 6.0, 5)]
    assert math.isfinite(S.TIER_TOP)


def test_poisson_sums_stay_near_the_total_and_ignore_row_order(spark):
    rows = [(f"k{i}", i % 2, float(i % 7)) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, g int, x double")
    got = {(r.g, r.draw): r.x for r in B.poisson_sums(df, ["g"], "k", 20, x=F.col("x")).collect()}
    again = {(r.g, r.draw): r.x for r in B.poisson_sums(df.repartition(7), ["g"], "k", 20, x=F.col("x")).collect()}
    assert got == again and len(got) == 40
    for g in (0, 1):
        total = sum(x for _, h, x in rows if h == g)
        draws = [got[g, d] for d in range(20)]
        # A Poisson sum has a variance of the sum of squares.
        sd = sum(x * x for _, h, x in rows if h == g) ** 0.5
        assert abs(np.mean(draws) - total) < 4 * sd / 20**0.5 and 0.4 * sd < np.std(draws) < 1.8 * sd


def test_array_uniforms_equal_the_column_expression(spark):
    from caselens.functions import rng

    got = [r[0] for r in spark.range(1, 500).select(rng.uniform(F.lit(11).cast("long"), F.col("id"))).collect()]
    assert np.array_equal(got, rng.uniforms(11, np.arange(1, 500)))


def test_text_seed_mixes_every_character(spark):
    from caselens.functions import rng

    def plain(text):
        seed = 20260820
        for ch in text:
            seed = (seed ^ ord(ch)) * 16777619 % 2**32
        return seed

    names = ["CA", "AC", "", "NATION_7"]
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(rng.text_seed(F.col("n"))).collect()]
    assert got == [plain(n) for n in names]


def test_row_wise_isotonic_projection_pools_violators(spark):
    from caselens.functions import quantiles as Q

    def plain(v):
        blocks = []
        for x in v:
            blocks.append([x, 1])
            while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
                x2, n2 = blocks.pop()
                x1, n1 = blocks.pop()
                blocks.append([(x1 * n1 + x2 * n2) / (n1 + n2), n1 + n2])
        return [x for x, n in blocks for _ in range(n)]

    r = np.random.default_rng(3)
    rows = [r.normal(size=5).tolist() for _ in range(60)] + [[1.0] * 5, [5.0, 4.0, 3.0, 2.0, 1.0]]
    got = [x[0] for x in spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v array<double>").orderBy("i").select(Q.isotonic(F.col("v"), 5)).collect()]
    assert np.allclose(got, [plain(v) for v in rows])


def test_shifts_of_all_groups_meet_the_goal(spark):

    rows = [(g, (i % 11) / 3 - k, 1.0 + i % 3) for k, g in enumerate("abc") for i in range(60)]
    df = spark.createDataFrame(rows, "g string, z double, w double")
    shifts = {r.g: r.shift for r in I.intercept_shifts(df, "g", "z", "w", 0.4).collect()}
    for g in "abc":
        p = [(w / (1 + math.exp(-(z + shifts[g]))), w) for h, z, w in rows if h == g]
        assert abs(sum(a for a, _ in p) / sum(w for _, w in p) - 0.4) < 1e-8


def test_running_sums_of_one_large_group_are_cut_into_ranges(spark):
    from caselens.operators import windows as X

    n = 4000
    df = spark.range(n).select(F.lit("hot").alias("g"), F.lit(1).alias("tie"), F.concat(F.lit("k"), F.lpad("id", 5, "0")).alias("key"), (F.col("id") % 7).cast("double").alias("w"))
    df = df.unionAll(spark.createDataFrame([("cold", 1, "a", 2.0), ("cold", 0, "b", 3.0)], "g string, tie int, key string, w double")).repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        out = X.running_before(df, ["g"], [F.desc("tie"), F.asc("key")], "w", "before")
        got = {(r.g, r.key): r.before for r in out.collect()}
        placed = {(r.g, r.key): r.p for r in X.places(df, ["g"], [F.desc("tie"), F.asc("key")], "p").collect()}
        ranges = df.repartitionByRange(16, "g", F.desc("tie"), "key").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    upto = 0.0
    for i in range(n):
        assert got["hot", f"k{i:05d}"] == upto and placed["hot", f"k{i:05d}"] == i + 1
        upto += i % 7
    assert (got["cold", "a"], got["cold", "b"]) == (0.0, 2.0) and (placed["cold", "a"], placed["cold", "b"]) == (1, 2)
    # Equal leading keys of one group spread over the ranges.
    assert len(ranges) > 8 and max(r[1] for r in ranges) < n / 8


def test_hot_deck_meets_a_slice_of_a_large_cell(spark, monkeypatch):
    from caselens.functions import rng
    from caselens.operators import impute

    monkeypatch.setattr(impute, "A_SLICE", 8)
    donors = spark.range(500).select(F.concat(F.lit("d"), F.lpad("id", 4, "0")).alias("key"), F.lit("x").alias("c"), F.when(F.col("id") == 9, 300.0).otherwise(1.0 + F.col("id") % 3).alias("w"), F.col("id").alias("v"))
    asking = spark.range(400).select(F.concat(F.lit("r"), "id").alias("key"), F.lit("x").alias("c"))
    got = {r.key: r.donor for r in impute.hot_deck(asking, donors, "key", [["c"]], "w", "v", "s").collect()}
    rows = sorted((r.key, r.w) for r in donors.collect())
    total, upto, ends = sum(w for _, w in rows), 0.0, []
    for key, w in rows:
        upto += w
        ends.append((upto / total, key))
    for r in asking.select("key", rng.hash_uniform(F.lit("s"), F.col("key")).alias("u")).collect():
        assert got[r.key] == next(k for end, k in ends if r.u < end)
    assert len(got) == 400 and len(set(got.values())) > 100
