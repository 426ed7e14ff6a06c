import numpy as np

from caselens.llm import cover_tree
from pyspark.sql import functions as F


def brute(rows, k=5):
    vec = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            vec.setdefault((i, tuple(np.floor(256 * np.array(v, float)).astype(int).tolist())), 1)
    out = set()
    for i, q in vec:
        if i % 50 == 0:
            found = sorted({(-sum(a * b for a, b in zip(q, x)), j) for j, x in vec if j != i})[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(found)}
    return out


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 8))
    rows = [(i, (base[i % 40] + rng.normal(size=8) * (i % 3) * 0.1).tolist()) for i in range(600)]
    rows += [(700 + i, base[3].tolist()) for i in range(60)]  # ties
    rows += [(800, None), (850, [None] * 8), (900, [float("nan")] * 8), (950, [float("inf")] * 8), (None, base[0].tolist()), (1000, base[1].tolist()), (1000, base[1].tolist())]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, block int, score int").repartition(5)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    for block in (64, 4096):
        got = {tuple(r) for r in cover_tree.top_k(df, F.col("vec_id") % 50 == 0, block=block, query_block=8).collect()}
        assert got == brute(rows)


def test_few_rows_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in cover_tree.top_k(df, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 65536)]
    assert cover_tree.top_k(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_tree_is_a_cover_tree():
    x = np.random.default_rng(2).normal(size=(3000, 5))
    tree = cover_tree.Tree(x, leaf=8)
    depth = [0]
    for p in tree.parent[1:]:
        depth.append(depth[p] + 1)
    for n in range(len(tree.centre)):
        rows = tree.below[n]
        assert np.sqrt(((x[rows] - x[tree.centre[n]]) ** 2).sum(1)).max() <= tree.radius[n] + 1e-9
        if kids := tree.children[n]:
            assert not len(tree.rows[n]) and tree.centre[n] in tree.centre[kids]  # nested
            assert sorted(np.concatenate([tree.below[c] for c in kids]).tolist()) == sorted(rows.tolist())
            c = x[tree.centre[kids]]
            apart = np.sqrt(((c[:, None] - c[None]) ** 2).sum(2))[~np.eye(len(kids), dtype=bool)]
            away = np.sqrt(((c - x[tree.centre[n]]) ** 2).sum(1))
            # Siblings lie at least as far apart as their level's scale, and that covers them.
            assert len(set(tree.centre[kids])) == len(kids) and apart.min(initial=9) * cover_tree.BASE >= away.max() / cover_tree.BASE
    assert max(depth) > 5 and sorted(np.concatenate(tree.rows).tolist()) == list(range(3000))


def test_clustered_vectors_are_pruned_and_exact():
    rng = np.random.default_rng(7)
    middle = rng.normal(size=(40, 16))
    make = lambda n: np.floor(256 * (middle[rng.integers(0, 40, n)] + 0.05 * rng.normal(size=(n, 16))))
    data, queries = make(4000), make(200)
    ids = rng.permutation(4000)
    best = cover_tree.search(cover_tree.Tree(queries, cover_tree.QUERY_LEAF), np.arange(200) + 9000, cover_tree.Tree(data), ids, 5)
    score = (queries @ data.T).astype(int)
    for q in range(200):
        want = sorted((-s, i) for s, i in zip(score[q].tolist(), ids.tolist(), strict=True))[:5]
        assert [(-s, i) for s, i in zip(best.score[q].tolist(), best.id[q].tolist(), strict=True)] == want
    assert best.scored < 0.3 * score.size


def test_one_common_vector_spreads_over_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 0.5, -0.25]) for i in range(300)] + [(300 + i, rng.normal(size=3).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {tuple(r) for r in cover_tree.top_k(df, F.col("vec_id") % 50 == 0, block=40, query_block=4, sample=64).collect()}
    assert got == brute([(r.vec_id, r.embedding) for r in df.collect()])


def test_large_numbers_stay_exact():
    q, x = np.array([[2.0**40, 3.0]]), np.array([[2.0**30, 1.0], [2.0**30, 2.0]])
    assert cover_tree.products(q, x).tolist() == [[min(2**70 + 3, 2**63 - 1)] * 1 + [2**63 - 1]]
