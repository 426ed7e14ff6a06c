"""Histogram trees, folds and importance against plain single-process versions."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from caselens.operators import boosting as H
from caselens.operators import folds as V
from pyspark.sql import functions as F

NAMES = ["a", "b", "c"]


def table(n=400, seed=1):
    rng = np.random.default_rng(seed)
    a, b, e = rng.integers(0, 9, n), rng.normal(size=n).round(2), rng.normal(size=n)
    y = np.where(a > 4, 2.0, 0.0) + b + 0.3 * e
    b = [None if rng.random() < 0.2 and v > 0.5 else float(v) for v in b]
    return [(f"k{i}", int(a[i]), b[i], float(i % 3), float(y[i]), float(rng.integers(1, 5)), i % 4) for i in range(n)]


@pytest.fixture(scope="module")
def stored(spark):
    df = spark.createDataFrame(table(), "id string, a int, b double, c double, y double, w double, fold int").repartition(3)
    cuts = H.cut_points(df.where("fold <> 0"), NAMES, 8)
    out = H.binned(df, NAMES, cuts, target="y", weight="w", fold="fold", key="id").cache()
    return out, np.array([r.x for r in out.collect()]), [(r.y, r.w, r.fold, r.key) for r in out.collect()]


def plain_split(x, g, h, rows, bins, least):
    """The best (feature, cut, missing right) of some rows, by trying all."""
    score = lambda s: sum(g[i] for i in s) ** 2 / (sum(h[i] for i in s) + H.SHRINK)
    best, top = None, 1e-9
    for f in range(x.shape[1]):
        for cut in range(1, bins - 1):
            for right in (False, True):
                left = [i for i in rows if (not right if x[i, f] == 0 else x[i, f] <= cut)]
                other = sorted(set(rows) - set(left))
                if sum(h[i] for i in left) < least or sum(h[i] for i in other) < least:
                    continue
                gain = score(left) + score(other) - score(rows)
                if gain > top * (1 + 1e-7) if best else gain > top:
                    best, top = (f, cut, right, left, other), gain
    return best


def plain_tree(x, g, h, rows, bins, least, depth):
    """Splits by heap node, and the rows of every leaf."""
    at, splits = {0: rows}, {}
    for node in range(2**depth - 1):
        split = plain_split(x, g, h, at[node], bins, least) if at[node] else None
        splits[node] = split[:3] if split else None
        at[2 * node + 1], at[2 * node + 2] = split[3:] if split else (at[node], [])
    return splits, [at[i] for i in range(2**depth - 1, 2 ** (depth + 1) - 1)]


def splits_of(forest, r, m):
    return {n: None if f < 0 else (int(f), int(c), bool(q)) for n, (f, c, q) in enumerate(zip(forest.feature[r][m], forest.cut[r][m], forest.missing_right[r][m], strict=True))}


def quantile(pairs, level):
    pairs, total, upto = sorted(pairs), sum(w for _, w in pairs), 0.0
    for v, w in pairs:
        upto += w
        if upto >= level * total - 1e-9 * total:
            return v
    return 0.0


def test_boosted_quantiles_equal_a_plain_version(stored):
    df, x, rows = stored
    y, w, fold = (np.array([r[i] for r in rows]) for i in range(3))
    seen = [i for i in range(len(rows)) if fold[i] != 0]
    levels, rate, depth, least = [0.25, 0.9], 0.5, 2, 10.0
    forest = H.boosted_quantiles(df, 3, levels, excluded=[0], rounds=3, depth=depth, rate=rate, bins=8, least=least)
    step = (y[seen].max() - y[seen].min()) / H.GRID
    for m, level in enumerate(levels):
        assert forest.start[m] == pytest.approx(quantile([(y[i], w[i]) for i in seen], level), abs=step)
        now = np.full(len(rows), forest.start[m])
        for r in range(3):
            g = {i: w[i] * (level - (y[i] <= now[i])) for i in seen}
            splits, leaves = plain_tree(x, g, dict(enumerate(w)), seen, 9, least, depth)
            assert splits_of(forest, r, m) == splits
            for leaf, inside in enumerate(leaves):
                want = rate * quantile([(y[i] - now[i], w[i]) for i in inside], level)
                assert forest.value[r][m, leaf] == pytest.approx(want, abs=2 * step)
            now = forest.raw_of(np.ascontiguousarray(x.T.astype(np.uint16)), m, r + 1)
    loss = lambda q: np.mean(np.maximum(0.9 * (y - q), -0.1 * (y - q))[fold == 0])
    assert loss(now) < 0.75 * loss(forest.start[1])


def test_probabilities_route_missing_values(stored):
    df, x, rows = stored
    target = df.withColumn("y", (F.get("x", F.lit(1)) == 0).cast("double"))
    forest = H.boosted_probabilities(target, 3, excluded=[(), (1,)], rounds=4, depth=2, rate=0.3, bins=8, least=1.0)
    p = 1 / (1 + np.exp(-forest.raw(np.ascontiguousarray(x.T.astype(np.uint16)))))
    missing = x[:, 1] == 0
    assert missing.any() and p[missing].min() > 0.6 > 0.3 > p[~missing].max()
    y, w = missing.astype(float), np.array([r[1] for r in rows])
    g, h = w * (y - 0.5), w * 0.25
    splits, leaves = plain_tree(x, g, h, list(range(len(rows))), 9, 1.0, 2)
    assert splits_of(forest, 0, 0) == splits
    assert [float(v) for v in forest.value[0][0]] == pytest.approx([0.3 * sum(g[i] for i in s) / (sum(h[i] for i in s) + H.SHRINK) for s in leaves])


def test_quantile_forest_equals_a_plain_version(stored):
    df, x, rows = stored
    y, w, fold, key = (np.array([r[i] for r in rows]) for i in range(4))
    forest = H.quantile_forest(df, 3, excluded=[0], trees=3, depth=2, cells=512, bins=8, least=15.0)
    times = H.times_drawn(key.astype(np.int64), 3)
    assert set(np.unique(times)) <= set(range(8)) and abs(times.mean() - 1) < 0.1
    middle = np.mean([y[i] for i in range(len(y)) if fold[i] != 0])
    member = []
    for t in range(3):
        seen = [i for i in range(len(rows)) if fold[i] != 0 and times[i, t]]
        weight = dict(enumerate(w * times[:, t]))
        splits, leaves = plain_tree(x, {i: weight[i] * (y[i] - middle) for i in seen}, weight, seen, 9, 15.0, 2)
        assert splits_of(forest.trees, 0, t) == splits
        member.append((leaves, weight))
    xt = np.ascontiguousarray(x.T.astype(np.uint16))
    got = forest.quantiles(xt, [0.1, 0.5, 0.9])
    for i in range(0, len(rows), 7):
        law = Counter()
        for t, (leaves, weight) in enumerate(member):
            inside = leaves[int(forest.trees.nodes(xt, 0, t, 2)[i])]
            total = sum(weight[j] for j in inside)
            for j in inside:
                law[y[j]] += weight[j] / total
        for k, level in enumerate((0.1, 0.5, 0.9)):
            # Values share cells of the grid: within a cell's width of the exact quantile.
            assert got[i, k] == pytest.approx(quantile(list(law.items()), level), abs=0.08)
    assert (np.diff(got, axis=1) >= 0).all()


def test_medians_come_from_training_rows_alone(spark):
    from caselens.plans import learning

    rows = [(*[float(i)] * 6, 1.0, None if i % 2 else float(i), int(i >= 50)) for i in range(100)]
    df = spark.createDataFrame(rows, "base double, discount double, score double, line double, grp_no double, period double, agency1 double, agency2 double, fold int")
    filled, medians = learning._imputed(df)
    assert medians[0] == 74.0 and medians[7] == 74.0  # rows of fold 0 hold 0 to 49
    assert filled.where("agency2 IS NULL").count() == 0 and filled.where("fold = 0 AND agency2 = 74").count() == 25


def test_folds_are_dealt_evenly_within_strata(spark, monkeypatch):
    df = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("id"), (F.col("id") % 7 == 0).alias("y"), F.floor(F.col("id") / 1100).alias("band"))
    want = {r.id: r.fold for r in V.stratified(df, ["y", "band"], "id", 5).collect()}
    monkeypatch.setattr(V, "RANGE_ROWS", 64)  # many ranges, the same places
    got = V.stratified(df.repartition(7), ["y", "band"], "id", 5).collect()
    assert {r.id: r.fold for r in got} == want
    counts = Counter((r.y, r.band, r.fold) for r in got)
    for y, band in {k[:2] for k in counts}:
        n = [counts[y, band, f] for f in range(5)]
        assert max(n) - min(n) <= 1


def test_no_row_is_scored_or_calibrated_by_what_saw_it(stored):
    df, _, _ = stored
    labelled = df.withColumn("y", (F.col("y") > 0.8).cast("double"))
    how = {"rounds": 3, "depth": 2, "bins": 8}
    first, levels, _, out_of = V.nested_scores(labelled, 3, 4, **how)
    assert sorted(out_of) == sorted([(k,) for k in range(4)] + [(j, k) for j in range(4) for k in range(j + 1, 4)])
    changed = labelled.withColumn("y", F.when(F.col("fold") == 0, 1 - F.col("y")).otherwise(F.col("y"))).withColumn("w", F.when(F.col("fold") == 0, 9.0).otherwise(F.col("w")))
    second, other, _, _ = V.nested_scores(changed, 3, 4, **how)
    take = lambda d: sorted((r.key, round(r.raw, 9), round(r.p, 9)) for r in d.where("fold = 0").collect())
    assert take(first) == take(second) and np.allclose(levels[0], other[0]) and not np.allclose(levels[1], other[1])


def test_partners_are_permutations_and_importance_finds_what_matters(stored, spark, monkeypatch):
    df, x, _ = stored
    monkeypatch.setattr(V, "RANGE_ROWS", 50)
    both = V.shuffled_partners(df, "key", ["key"], 3).collect()
    for r in range(3):
        pairs = [(b.key, b.new_key) for b in both if b.repeat == r]
        assert len(pairs) == len(x) and {p[0] for p in pairs} == {p[1] for p in pairs} and sum(a == b for a, b in pairs) < len(x) / 20
    labelled = df.withColumn("y", (F.get("x", F.lit(0)) > 4).cast("double"))
    out = {r.feature: r for r in V.permutation_importance(labelled, NAMES, lambda b: np.clip(b[0] / 8.0, 0, 1), repeats=3).collect()}
    assert out["a"].auc_loss > 0.3 and out["a"].sd > 0 and out["b"].auc_loss == out["c"].auc_loss == 0 and out["a"].repeats == 3


def test_pooled_levels_are_the_nearest_rising_ones():
    rng = np.random.default_rng(2)
    for _ in range(20):
        w, y = rng.integers(0, 4, 12).astype(float), rng.random(12)
        got = H.pooled(w, y)
        on = w > 0
        assert (np.diff(got) >= -1e-12).all()
        wo, yo = w[on], y[on]
        # Largest over starts of the smallest weighted mean from there on.
        for i, v in enumerate(got[on]):
            want = max(min(np.average(yo[a : b + 1], weights=wo[a : b + 1]) for b in range(i, len(yo))) for a in range(i + 1))
            assert v == pytest.approx(want)
    assert (H.pooled(np.zeros(3), np.zeros(3)) == 0.5).all()


def test_a_fit_reads_rows_in_blocks_whatever_their_size(stored, monkeypatch):
    df, _, _ = stored
    how = {"rounds": 2, "depth": 2, "bins": 8, "least": 10.0}
    whole = H.boosted_probabilities(df.withColumn("y", (F.col("y") > 0.8).cast("double")), 3, excluded=[(0,), (0, 1)], **how)
    monkeypatch.setattr(H, "BLOCK", 64)  # many blocks, and features counted one by one
    blocked, rest = H.blocks(df, [(0,), (0, 1)], 8, False)
    sizes = [r.n for r in blocked.collect()]
    assert max(sizes) <= 64 and sum(sizes) == df.where("fold <> 0").count() and rest == [(), (1,)]
    small = H.boosted_probabilities(df.withColumn("y", (F.col("y") > 0.8).cast("double")), 3, excluded=[(0,), (0, 1)], **how)
    for r in range(2):
        assert all(splits_of(whole, r, m) == splits_of(small, r, m) for m in range(2)) and np.allclose(whole.value[r], small.value[r])


def test_quantiles_of_a_large_group_from_bins(spark, monkeypatch):
    from caselens.operators import windows as X

    rng = np.random.default_rng(4)
    rows = [("abc"[i % 3], None if i % 50 == 0 else float(np.round(rng.lognormal(), 2)) if i % 3 else 7.0, float(i % 6)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, x double, w double").repartition(3)
    levels = [0.05, 0.5, 0.9, 0.99, 1.0]
    take = lambda q: sorted((r.g, r.level, r.value) for r in q.collect())
    want = take(X.weighted_quantiles(df, ["g"], "x", "w", levels))
    for bins in (1, 16, 1 << 14):
        monkeypatch.setattr(X, "VALUE_BINS", bins)
        assert take(X.bracketed_quantiles(df, ["g"], "x", "w", levels)) == want


def test_empty_training_rows(spark):
    empty = spark.createDataFrame([], "x array<int>, y double, w double, fold int, key long")
    assert H.boosted_quantiles(empty, 2, [0.5], rounds=1, bins=4).start.tolist() == [0.0]
    assert H.quantile_forest(empty, 2, trees=2, depth=1, bins=4).trees.feature[0].max() == -1


def test_tables_of_leaves_equal_comparisons():
    rng = np.random.default_rng(6)
    widths = [5, 9, 3, 33, 12]
    x = np.stack([rng.integers(0, k, 700) for k in widths]).astype(np.uint8)
    for depth, rounds in ((1, 1), (2, 9), (3, 17), (4, 2)):
        forest = H.Forest(depth, 2, rng.normal(size=2))
        for _ in range(rounds):
            forest.grow()
            f = forest.feature[-1][:] = rng.integers(-1, len(widths), forest.feature[-1].shape)
            forest.cut[-1][:] = rng.integers(0, np.array(widths)[f])
            forest.missing_right[-1][:] = rng.random(f.shape) < 0.5
            forest.value[-1][:] = rng.normal(size=forest.value[-1].shape)
        for m in range(2):
            for r in sorted({0, rounds // 2, rounds - 1}):
                for level in range(depth + 1):
                    raw, node = H.Walk(forest, r, level, widths)(H.Rows(x), m)
                    assert np.allclose(raw, forest.raw_of(x, m, r), rtol=1e-12) and np.array_equal(node, forest.nodes(x, r, m, level))


def test_groups_of_features_hold_each_once_and_stay_small():
    for widths in ([33] * 8, [33, 12, 10, 8, 26, 8, 28, 29], [9] * 3, [40000, 2], [257] * 5):
        for nodes in (1, 4, 32):
            groups = H.grouped(widths, nodes)
            assert sorted(f for g in groups for f in g) == list(range(len(widths)))
            assert all(len(g) == 1 or np.prod([widths[f] for f in g]) * max(nodes, 4) <= H.BLOCK for g in groups)


def test_numbers_are_packed_without_loss():
    for values, size in (([0, 1, 255], 1), ([0.5, -3, 2**24], 4), ([0.1, 1, 2], 8), ([float("nan"), 1, 2], 8), ([256, 0, 1], 4), ([1e300, 0, 0], 8)):
        raw = H.packed(np.array(values))
        back = H.unpacked(pa.py_buffer(raw), 3)
        assert len(raw) == 3 * size and np.array_equal(back, np.array(values, float), equal_nan=True)


def test_blocks_are_of_one_fold_where_models_differ(stored, monkeypatch):
    df, x, rows = stored
    monkeypatch.setattr(H, "BLOCK", 50)
    blocked, rest = H.blocks(df, [(0,), (0, 1), (0, 2)], 8, False)
    assert rest == [(), (1,), (2,)]
    got = blocked.collect()
    assert Counter(r.fold for r in got).keys() == {1, 2, 3} and max(r.n for r in got) <= 50
    want = {r[3]: (tuple(b), r[0], r[1], r[2]) for b, r in zip(x, rows, strict=True) if r[2] != 0}
    have = {}
    for r in got:
        bins, values = np.frombuffer(r.x, np.uint8).reshape(-1, r.n).T, [H.unpacked(pa.py_buffer(bytes(v)), r.n) for v in (r.y, r.w)]
        for i, key in enumerate(np.frombuffer(r.key, np.int64)):
            have[key] = (tuple(bins[i]), values[0][i], values[1][i], r.fold)
    assert have == want
    assert {r.fold for r in H.blocks(df, [(0,), (0,)], 8, False)[0].collect()} == {None}


def test_rows_of_one_hash_are_dealt_by_their_keys(spark, monkeypatch):
    monkeypatch.setattr(V, "RANGE_ROWS", 100)
    rng = np.random.default_rng(8)
    rows = [(f"k{i}é" if i % 9 else f"{i}", bool(i % 7 == 0), int(i // 900), float(rng.integers(0, 40) / 40)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id string, y boolean, band int, _u double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "30")
    try:
        got = {r.id: r.fold for r in V.dealt(df, ["y", "band"], "id", 5).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, seen = {}, Counter()
    for key, y, band, _ in sorted(rows, key=lambda r: (r[3], r[0].encode())):
        want[key] = seen[y, band] % 5
        seen[y, band] += 1
    assert got == want


def test_nested_scores_equal_a_plain_version(stored):
    df, x, rows = stored
    labelled = df.withColumn("y", (F.col("y") > 0.8).cast("double"))
    got, levels, forest, out_of = V.nested_scores(labelled, 3, 4, rounds=3, depth=2, bins=8)
    score = 1 / (1 + np.exp(-forest.raw(np.ascontiguousarray(x.T.astype(np.uint8)))))
    y, w, fold = (np.array([r[i] for r in rows]) for i in range(3))
    y = (y > 0.8).astype(float)
    at = {frozenset(e): m for m, e in enumerate(out_of)}
    for k in range(4):
        weight, hit = np.zeros(V.SCORE_BINS), np.zeros(V.SCORE_BINS)
        for i in range(len(rows)):
            if fold[i] != k:
                cell = min(int(score[i, at[frozenset((k, fold[i]))]] * V.SCORE_BINS), V.SCORE_BINS - 1)
                weight[cell] += w[i]
                hit[cell] += w[i] * y[i]
        assert np.allclose(levels[k], H.pooled(weight, hit / np.maximum(weight, 1e-300)))
    seen = {r.key: (r.y, r.w, r.fold, r.raw, r.p) for r in got.collect()}
    for i, r in enumerate(rows):
        raw = score[i, at[frozenset((fold[i],))]]
        assert seen[r[3]] == pytest.approx((y[i], w[i], fold[i], raw, levels[fold[i]][min(int(raw * V.SCORE_BINS), V.SCORE_BINS - 1)]))
    # The forest's seen rows and the scores come from blocks: the rows handed over are read by one job.
    assert len(seen) == len(rows) and "blocks-" in got._jdf.queryExecution().executedPlan().toString()
