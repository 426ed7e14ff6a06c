"""Exact top-k inner products by a dual-tree cover-tree search (operator 2).

Vectors are quantised to integers. Queries and data share one index. Its top is
fitted on a bounded sample of SAMPLE rows: centres in farthest-first order, as
many as blocks of BLOCK rows are needed; every row goes to the nearest centre,
and a centre of more rows is dealt to several blocks by a hash, so copies of one
vector spread. Each block keeps its covering radius and longest vector. Within a
block's task the rows are indexed by a cover tree: the farthest-first order cut
where the distance to what was picked before falls below a level's scale, so a
level's centres are nested in the next level's, lie farther apart than the scale
and cover everything within it.

A query first meets the block of its own centre, which gives it a kth score to
start from. Then pairs of a query group and a block are left out whose bound, by
the centres' product, the covering radii and Cauchy-Schwarz, falls short of the
group's worst kth score; only the rest is shuffled, each block's data once, and
the groups that still ask it in turn. In the task both trees are walked together
and pairs of nodes are pruned the same way; leaves are scored by falling bound
as integer matrix products until no bound reaches the query leaf's worst kth
score.

The search is exact whatever the bounds prune. Nearly independent dimensions
leave nothing to prune: then every query is scored against every row, block by
block, a task holding one block and one query group.

Defined results: vectors that are null or hold null or non-finite components
take no part; shorter vectors count as padded with zeros; rows that repeat a
vec_id and its vector count once, and rows with the query's vec_id are its own;
a null vec_id takes no part; of equal scores the smaller vec_id comes first;
fewer candidates than k give fewer rows; scores beyond a long are held at its
limits; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import storage

K = 5
SCALE = 256
BLOCK = 4096
QUERY_BLOCK = 1024
SAMPLE = 4096
LEAF = 16
QUERY_LEAF = 4
#: A level's scale is that of the level below times this.
BASE = 1.3
_LONG = np.iinfo(np.int64)


def farthest_first(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows picked farthest-first from row 0, each one's distance to those before it, and
    every row's nearest pick (by its place) and distance to it."""
    size = (x * x).sum(1)
    away, owner = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
    picked, reach = [], []
    while len(picked) < most:
        new = int(away.argmax())
        if picked and away[new] <= 0:
            break
        reach.append(float(away[new]))
        d = np.sqrt(np.maximum(size + size[new] - 2 * (x @ x[new]), 0.0))
        d[new] = 0.0
        closer = d < away
        owner[closer] = len(picked)
        away = np.where(closer, d, away)
        picked.append(new)
    return np.array(picked, np.int64), np.array(reach), owner, away


class Tree:
    """A cover tree over the rows of ``x`` (doubles), as parallel arrays of nodes; leaves hold rows."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF, base: float = BASE):
        self.x = x
        picked, reach, owner, _ = farthest_first(x, max(1, -(-len(x) // leaf)))
        m = len(picked)
        top = reach[1] if m > 1 else 0.0
        # The level at which a pick becomes a centre: 0 for the first, then by falling distance.
        level = np.zeros(m, np.int64)
        if m > 1:
            level[1:] = 1 + np.floor(np.log(top / np.maximum(reach[1:], top * 1e-12)) / np.log(base) + 1e-12).astype(np.int64)
        self.parent, self.pick = [-1], [0]
        node_of = {0: 0}  # each pick's lowest node so far
        between = x[picked]
        for lv in range(1, int(level.max(initial=0)) + 1):
            new = np.flatnonzero(level == lv)
            if not len(new):
                continue
            old = np.flatnonzero(level < lv)
            d = (between[new] ** 2).sum(1)[:, None] + (between[old] ** 2).sum(1)[None, :] - 2 * between[new] @ between[old].T
            above = old[d.argmin(1)]
            for p in np.unique(above).tolist():  # a centre goes on as its own child
                self.parent.append(node_of[p])
                self.pick.append(p)
                now = len(self.pick) - 1
                for c in new[above == p].tolist():
                    self.parent.append(node_of[p])
                    self.pick.append(c)
                    node_of[c] = len(self.pick) - 1
                node_of[p] = now
        n = len(self.pick)
        self.centre = picked[np.array(self.pick)]
        self.children: list[list[int]] = [[] for _ in range(n)]
        for i, p in enumerate(self.parent[1:], 1):
            self.children[p].append(i)
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(m + 1))
        self.rows: list[np.ndarray] = [np.zeros(0, np.int64)] * n
        for p, i in node_of.items():
            self.rows[i] = order[cuts[p] : cuts[p + 1]]
        norms = np.sqrt((x * x).sum(1))
        self.radius, self.length = np.zeros(n), np.zeros(n)
        below: list[np.ndarray] = list(self.rows)
        for i in range(n - 1, -1, -1):
            rows = below[i] = np.concatenate([below[i], *(below[c] for c in self.children[i])]) if self.children[i] else below[i]
            if len(rows):
                self.radius[i] = np.sqrt(((x[rows] - x[self.centre[i]]) ** 2).sum(1).max())
                self.length[i] = norms[rows].max()
        self.below = below
        self.size = norms[self.centre]


class Best:
    """The k best (score, id) of every query, ties to the smaller id."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None):
        self.k = k
        self.score = np.full((n, k), _LONG.min, np.int64)
        self.id = np.full((n, k), _LONG.max, np.int64)
        self.scored = 0
        floor = np.full(n, -np.inf) if floor is None else floor
        self.floor = np.array([_LONG.min if f == -np.inf else int(f) for f in floor.tolist()], np.int64)

    def least(self, rows: np.ndarray) -> np.ndarray:
        """What a score must reach to matter to each of the queries."""
        return np.maximum(np.where(self.id[rows, -1] == _LONG.max, _LONG.min, self.score[rows, -1]), self.floor[rows])

    def worst(self, rows: np.ndarray) -> float:
        least = self.least(rows).min()
        return -np.inf if least == _LONG.min else float(least)

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        self.scored += score.size
        score = np.where(own, _LONG.min, score)
        least = self.least(rows)
        if score.shape[1] > self.k:
            least = np.maximum(least, np.partition(score, -self.k, axis=1)[:, -self.k])
        q, c = np.nonzero((score >= least[:, None]) & ~own)
        if not len(q):
            return
        hit = np.unique(q)
        row = np.concatenate([np.repeat(hit, self.k), q])
        value = np.concatenate([self.score[rows[hit]].ravel(), score[q, c]])
        name = np.concatenate([self.id[rows[hit]].ravel(), ids[c]])
        order = np.lexsort((name, ~value, row))
        first = np.searchsorted(row[order], hit)[:, None] + np.arange(self.k)
        self.score[rows[hit]], self.id[rows[hit]] = value[order[first]], name[order[first]]


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; held at the limits of a long."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 1 << 53:
        return np.rint(q @ x.T).astype(np.int64)
    exact = [[sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for v in x.tolist()] for u in q.tolist()]
    return np.array([[min(max(s, _LONG.min + 1), _LONG.max) for s in row] for row in exact], np.int64)


def search(a: Tree, query_ids: np.ndarray, b: Tree, data_ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> Best:
    """Each query's k best rows of the data's tree ``b`` that score at least its ``floor``."""
    queries, data = a.x, b.x
    best = Best(len(queries), k, floor)
    centres = queries[a.centre] @ data[b.centre].T

    def bound(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        r, t = a.radius[i], b.radius[j]
        top = np.minimum(centres[i, j] + a.size[i] * t + b.size[j] * r + r * t, a.length[i] * b.length[j])
        return top + 1e-9 * (1 + np.abs(top))

    worst = np.array([best.worst(rows) if len(rows) else np.inf for rows in a.below])
    leaves: dict[int, list[np.ndarray]] = {}
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(i):
        top = bound(i, j)
        keep = top >= worst[i]
        i, j, top = i[keep], j[keep], top[keep]
        end = np.array([not a.children[p] and not b.children[q] for p, q in zip(i.tolist(), j.tolist(), strict=True)], bool)
        for p in np.unique(i[end]).tolist():
            mine = end & (i == p)
            leaves.setdefault(p, []).append(np.stack([j[mine].astype(float), top[mine]]))
        pairs: list[tuple[int, int]] = []
        for p, q in zip(i[~end].tolist(), j[~end].tolist(), strict=True):
            # The node of the larger radius is opened; rows of an inner node are all below it.
            if b.children[q] and (not a.children[p] or b.radius[q] >= a.radius[p]):
                pairs += [(p, c) for c in b.children[q]]
            else:
                pairs += [(c, q) for c in a.children[p]]
        i, j = (np.array(x, np.int64) for x in (zip(*pairs, strict=True) if pairs else ((), ())))
    for p, met in leaves.items():
        rows = a.rows[p]
        if not len(rows):
            continue
        cells, tops = np.concatenate(met, axis=1)
        order = np.argsort(-tops, kind="stable")
        at, step = 0, 4
        while at < len(order) and tops[order[at]] >= best.worst(rows):
            some = order[at : at + step]
            some = some[tops[some] >= best.worst(rows)]
            cols = np.concatenate([b.rows[int(c)] for c in cells[some]])
            if len(cols):
                best.add(rows, products(queries[rows], data[cols]), data_ids[cols], query_ids[rows][:, None] == data_ids[cols][None, :])
            at, step = at + step, 2 * step
    return best


def quantised(vector: str) -> Column:
    """floor(SCALE * x) of each component as a double that holds an integer."""
    return F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * SCALE).cast("double"))


def usable(vector: str) -> Column:
    ok = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(ok, F.lit(False))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _placed(x: DataFrame, centres: np.ndarray) -> DataFrame:
    """Every row with its nearest centre, its distance to it and its length."""
    width = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1), width)
            near = ((centres * centres).sum(1)[None, :] - 2 * v @ centres.T).argmin(1)
            away = np.sqrt(((v - centres[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(away), pa.array(np.sqrt((v * v).sum(1)))], ["vec_id", "v", "q", "centre", "away", "length"])

    return x.select("vec_id", "v", "q").mapInArrow(run, "vec_id long, v array<double>, q boolean, centre int, away double, length double")


def _meet(asked: DataFrame, data: DataFrame, k: int, width: int) -> DataFrame:
    """(query_id, vec_id, score) of the k best rows of each block for the queries that ask it."""
    names = ["query_id", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, tree, ids = None, None, None, np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def done() -> Iterator[pa.RecordBatch]:
            """Data that is whole becomes the block's tree; a query group that is whole searches it."""
            nonlocal tree, ids
            if not held:
                return
            v, name, floor = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            if group == -1:
                tree, ids = Tree(v), name
            elif tree is not None:
                best = search(Tree(v, QUERY_LEAF), name, tree, ids, k, floor)
                found = (best.id != _LONG.max) & (best.score >= best.floor[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, k)[found.ravel()]), pa.array(best.id[found]), pa.array(best.score[found])], names)

        for batch in batches:
            block, part = (batch.column(c).to_numpy() for c in (0, 1))
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(part) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)], strict=True):
                if (block[lo], part[lo]) != (now, group):
                    yield from done()
                    if block[lo] != now:
                        tree = None
                    now, group = block[lo], part[lo]
                piece = batch.slice(lo, hi - lo)
                held.append((_matrix(piece.column(3), width), piece.column(2).to_numpy(), piece.column(4).to_numpy()))
        yield from done()

    rows = asked.select("block", "part", "vec_id", "v", "floor").unionAll(data.select("block", F.lit(-1).cast("long").alias("part"), "vec_id", "v", F.lit(0.0).alias("floor")))
    rows = rows.repartition("block").sortWithinPartitions("block", "part")
    return rows.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(rows: DataFrame, is_query: Column, *, k: int = K, block: int = BLOCK, query_block: int = QUERY_BLOCK, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best rows of every query, from (vec_id, embedding)."""
    spark = rows.sparkSession
    x = rows.where(usable("embedding") & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), quantised("embedding").alias("v"), is_query.alias("q"))
    x = storage.materialize(x.distinct(), "vectors")
    n, width = x.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width = max(width, 1)
    x = x.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v"))))
    # A bounded sample fits the top of the index; every row is indexed.
    drawn = x.orderBy(F.xxhash64("vec_id", "v")).select("v").limit(sample).toArrow()["v"].combine_chunks()
    points = _matrix(drawn, width) if n else np.zeros((1, width))
    centres = points[farthest_first(points, max(1, -(-n // block)))[0]]
    placed = storage.materialize(_placed(x, centres), "placed")

    counted = placed.groupBy("centre").agg(F.ceil(F.count("*") / block).alias("parts"), F.ceil(F.count_if("q") / query_block).alias("groups"))
    placed = placed.join(F.broadcast(counted), "centre")  # at most ``sample`` rows
    deal = lambda seed, parts: F.pmod(F.xxhash64("vec_id", "v", F.lit(seed)), F.greatest(F.lit(1), F.col(parts)))
    numbered = placed.withColumn("block", F.col("centre").cast("long") * (1 << 32) + deal(0, "parts")).withColumn("part", F.col("centre").cast("long") * (1 << 32) + deal(1, "groups"))
    numbered = storage.materialize(numbered.select("vec_id", "v", "q", "centre", "away", "length", "block", "part", "parts"), "numbered")
    low = F.lit(float("-inf"))
    queries = numbered.where("q").select("part", "centre", "away", "length", "vec_id", "v", "parts")
    home = F.col("centre").cast("long") * (1 << 32) + F.pmod("part", "parts")
    own = storage.materialize(_meet(queries.withColumn("block", home).withColumn("floor", low), numbered, k, width), "own")

    kth = own.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("s")).select(F.col("query_id").alias("vec_id"), F.when(F.col("n") >= k, F.col("s").cast("double")).otherwise(low).alias("floor"))
    asking = storage.materialize(queries.withColumn("home", home).join(kth, "vec_id", "left").withColumn("floor", F.coalesce("floor", low)), "asking")
    middles = spark.createDataFrame(list(enumerate(centres.tolist())), "centre int, c array<double>")
    reach = [F.max("away").alias("r"), F.max("length").alias("l")]
    groups = asking.groupBy("part", "centre", "home").agg(*reach, F.min("floor").alias("worst")).join(middles, "centre").alias("g")
    blocks = numbered.groupBy("block", "centre").agg(*reach).join(middles, "centre").alias("b")
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    g, b = (lambda c: F.col(f"g.{c}")), (lambda c: F.col(f"b.{c}"))
    top = F.least(dot(g("c"), b("c")) + F.sqrt(dot(g("c"), g("c"))) * b("r") + F.sqrt(dot(b("c"), b("c"))) * g("r") + g("r") * b("r"), g("l") * b("l"))
    pairs = groups.join(blocks, (g("home") != b("block")) & (top + 1e-9 * (1 + F.abs(top)) >= g("worst")))
    pairs = storage.materialize(pairs.select(g("part").alias("part"), b("block").alias("block")), "pairs")
    asked = asking.select("part", "vec_id", "v", "floor").join(pairs, "part")
    found = own.unionAll(_meet(asked, numbered.join(pairs.select("block").distinct(), "block", "left_semi"), k, width))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
