import hashlib

import numpy as np
import pytest

from caselens.llm import equal_average


def brute(rows, dims=4, k=5, rounds=5):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    kept = [(i, [max(-(2**62), min(2**62, x)) for x in v]) for i, v in kept]
    digest = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return [min((far(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        own = assign()
        for j in range(len(centroids)):
            if of := [v for (_, v), (_, c) in zip(kept, own, strict=True) if c == j]:
                centroids[j] = [sum(x) // len(of) for x in zip(*of, strict=True)]
    own, top = [(min(d, equal_average.LARGEST), j) for d, j in assign()], equal_average.LARGEST
    total = {j: min(sum(d for d, c in own if c == j), top) for j in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([str((i, c, d, total[c], min(sum(total.values()), top), sha[c])) for (i, _), (d, c) in zip(kept, own, strict=True)])


def run(spark, rows, kind="float", **how):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster int, inertia long").repartition(3)
    out = equal_average.clusters(df, dims=4, k=5, **how)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(str(tuple(r)) for r in out.collect())


def test_clusters_equal_plain_rounds(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(200)]
    rows += [(200 + i, [0.5, 0.25, -1.0, 0.0]) for i in range(90)]  # ties
    rows += [rows[0], rows[0], (None, [0.1] * 4), (301, None), (302, [1.0, None, 0.0, 0.0]), (303, [float("nan")] * 4), (304, [float("inf"), 0.0, 0.0, 0.0]), (305, [1.0]), (306, [])]
    rows = [(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert run(spark, rows) == brute(rows)


def test_few_equal_large_and_no_vectors(spark):
    few = [(1, [1.0, 2.0, 3.0, 4.0]), (2, [1.0, 2.0, 3.0, 4.0]), (3, [-1.0, 0.0, 0.0, 0.0])]
    assert run(spark, few, "double") == brute(few)
    large = [(i, [1e30 * (-1) ** i, 2.0**40 * i, -1e12 * i, 1.0]) for i in range(12)]
    assert run(spark, large, "double") == brute(large)
    assert run(spark, [(5, None)]) == []


@pytest.mark.parametrize("spread", [3, 400])
def test_search_is_exact_and_passes_over_centroids(spread):
    rng = np.random.default_rng(spread)
    # Means differ between clusters, so both bounds can reject.
    middles = rng.integers(-900, 900, (40, 1)) + rng.integers(-spread, spread, (40, 64))
    middles[7] = middles[3]
    x = middles[rng.integers(0, 40, 3000)] + rng.integers(-20, 20, (3000, 64))
    search = equal_average.Search(middles)
    cluster, distance = search.nearest(x)
    every = ((x[:, None] - middles[None]) ** 2).sum(2)
    assert (cluster == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert search.measured < 0.25 * every.size
