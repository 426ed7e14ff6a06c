"""Near-duplicates by a chosen-path set-similarity join (operator 6).

A document is the set of its word shingles; documents with equal sets form a
class, and one document stands for a class. In each of TREES independent trees
a random order of all tokens is drawn, and a set walks down from the root along
its lowest tokens: its lowest one leads to its node at the first level, and in
a node of more than LIMIT sets it branches on to one child for each of its next
two tokens. Two sets stay together at a step with a chance of their Jaccard
similarity or more. Branching goes on for as long as a node is large and its
children are much smaller, so the depth follows the data: a line that a third
of all documents share only makes its nodes deeper.

A node of at most LIMIT sets is compared exhaustively in one task. A node that
keeps half of its sets or more in one child is a group of near-copies that no
branching parts (as is what is still large KEEP tokens down). It is first
thinned: dealt into parts of about LIMIT / 2 sets, HUB of which share their
smallest document, differently in every tree. What these links leave in
different components is then compared whole, part against part of about
2 * LIMIT sets each, so every two sets of such a node are compared or already
linked. Only parts of one component, and parts whose sizes rule a link out,
skip each other. LIMIT thus decides cost alone. A pair at the threshold that
shares no small node in one tree does so in another: it is missed with a chance
of (1 - 0.8) ** TREES, about 0.0001, where nodes are small, and of about 0.001
where they branch twice; the work in a group of near-copies grows with the
square of the sets that its first links leave in different components.

Comparisons use the full sets. Only a spanning forest of a node's links leaves
its task, and nodes with the same members in several trees are compared once.
Components come from the links by rounds of Spark jobs.

Defined results: null and wordless texts have an empty set and are linked with
nothing; with fewer words than a shingle the whole sequence is one; texts of any
length are compared whole; rows with one doc_id are one document; rows with a
null doc_id are linked with nothing, have a null component and are kept; an
empty table gives no rows; other columns are ignored by :func:`groups` and kept
by :func:`drop_near_copies`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops, components, storage

WORDS = 5
PERCENT = 80
TREES = 6
KEEP = 6
BRANCH = 2
LIMIT = 256
PART = 1 << 21
#: Parts that share a document; bytes of sets in a batch; ids of sets that are broadcast at most.
HUB = 256
BATCH = 1 << 24
FEW = 100_000


def _lowest(tokens: np.ndarray, trees: int, keep: int) -> np.ndarray:
    """In each tree, the set's lowest tokens in the tree's order, as 31 bits of each; -1 where there are fewer."""
    seeds = bytesops.mix(np.arange(trees, dtype=np.uint64), 5)
    ranked = (tokens[None, :] ^ seeds[:, None]) * np.uint64(0xD6E8FEB86659FD93)
    ranked ^= ranked >> np.uint64(32)
    ranked *= np.uint64(0xA0761D6478BD642F)
    ranked ^= ranked >> np.uint64(29)
    if len(tokens) > keep:
        ranked = np.partition(ranked, keep - 1, axis=1)[:, :keep]
    out = np.full((trees, keep), -1, np.int32)
    out[:, : ranked.shape[1]] = (np.sort(ranked, axis=1) & np.uint64(0x7FFFFFFF)).astype(np.int32)
    return out.ravel()


def _class_name(tokens: np.ndarray) -> list[int]:
    return np.frombuffer(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest(), "<i8").tolist()


def _sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    buf, offs = bytesops.text_bytes(column)
    for first, last in bytesops.row_blocks(offs):
        yield from bytesops.shingle_sets(buf[offs[first] : offs[last]], offs[first : last + 1] - offs[first], words)


def _sketches(docs: DataFrame, words: int, trees: int, keep: int) -> DataFrame:
    """doc_id, n_shingles, class (two longs) and lowest tokens of every row; null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, names, paths = [], [], []
            for tokens in _sets(batch.column(1), words):
                size.append(len(tokens))
                names.append(_class_name(tokens) if len(tokens) else [None, None])
                paths.append(_lowest(tokens, trees, keep) if len(tokens) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), *(pa.array([n[i] for n in names], pa.int64()) for i in (0, 1)), pa.array(paths, pa.list_(pa.int32()))], ["doc_id", "n_shingles", "c1", "c2", "paths"])

    storage.small_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, "doc_id long, n_shingles long, c1 long, c2 long, paths array<int>")


def _nodes(classes: DataFrame, trees: int, keep: int, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """(node, rep) of the nodes of two sets to ``limit``, and of the larger ones that don't part."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    at = classes.select("rep", "paths", tree).select("rep", "tree", F.xxhash64("tree", F.get("paths", F.col("tree") * keep)).alias("node"))
    at = storage.materialize(at, "paths")
    sizes = at.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
    met = storage.materialize(at.join(sizes, "node"), "met")
    leaves, dense = [met.where(F.col("n") <= limit).select("node", "rep")], []
    big = met.where(F.col("n") > limit).join(classes.select("rep", "paths"), "rep")
    big = big.select("node", "rep", "n", F.slice("paths", F.col("tree") * keep + 1, F.lit(keep)).alias("low"), F.lit(0).alias("pos"))
    big = storage.materialize(big, "big")
    while not big.isEmpty():
        # The paths that have come to their last token can't branch.
        on = F.explode(F.sequence(F.col("pos") + 1, F.least(F.col("pos") + BRANCH, F.lit(keep - 1)))).alias("pos")
        kids = big.where(F.col("pos") < keep - 1).select(F.col("node").alias("parent"), F.col("n").alias("whole"), "rep", "low", on)
        kids = kids.withColumn("node", F.xxhash64("parent", F.get("low", "pos")))
        kids = storage.materialize(kids, "kids")
        sizes = kids.groupBy("parent", "node").agg(F.count("*").alias("n"), F.first("whole").alias("whole"))
        parted = sizes.groupBy("parent").agg(F.max("n").alias("most"), F.first("whole").alias("whole")).where("2 * most < whole").select("parent")
        dense.append(big.join(parted, big["node"] == parted["parent"], "left_anti").select("node", "rep"))
        sizes = sizes.where("n > 1").join(parted, "parent", "left_semi").select("node", "n")
        met = storage.materialize(kids.join(sizes, "node").select("node", "rep", "n", "low", "pos"), "met")
        leaves.append(met.where(F.col("n") <= limit).select("node", "rep"))
        big = met.where(F.col("n") > limit)
    return reduce(DataFrame.unionAll, leaves), reduce(DataFrame.unionAll, dense) if dense else None


def _thinned(dense: DataFrame, limit: int) -> DataFrame:
    """(part, rep): every node dealt into parts of about ``limit / 2`` sets; HUB parts share their smallest document."""
    sizes = dense.groupBy("node").agg(F.ceil(F.count("*") / (limit // 2)).alias("parts"))
    dealt = dense.join(sizes, "node").select("node", "rep", F.pmod(F.xxhash64("rep", "node"), F.col("parts")).alias("part"))
    named = lambda rep: [F.xxhash64("node", "part").alias("node"), rep.alias("rep")]
    hubs = dealt.groupBy("node", F.floor(F.col("part") / HUB).alias("hub")).agg(F.min("rep").alias("first"), F.max("part").alias("last"))
    hubs = hubs.select("node", "first", F.explode(F.sequence(F.col("hub") * HUB, F.col("last"))).alias("part"))
    return dealt.select(*named(F.col("rep"))).unionAll(hubs.select(*named(F.col("first"))))


def _open_pairs(dense: DataFrame, classes: DataFrame, component: DataFrame, *, percent: int, limit: int) -> DataFrame | None:
    """(node, rep) of every two parts of a large node that may still hold an unknown link between
    components; None where no node has two components."""
    most = 2 * limit
    rows = dense.join(component.select(F.col("node").alias("rep"), "component"), "rep", "left")
    rows = rows.join(classes.select("rep", "n_shingles"), "rep").select("node", "rep", "n_shingles", F.coalesce("component", "rep").alias("component"))
    rows = storage.materialize(rows, "dense")
    open_ = storage.materialize(rows.groupBy("node").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("node"), "open")
    if open_.isEmpty():
        return None
    rows = rows.join(open_, "node", "left_semi")
    held = rows.groupBy("node", "component").agg(F.count("*").alias("n"))
    still = held.groupBy("node").agg(F.sum(F.when(F.col("n") <= most, F.col("n"))).alias("rest"))
    rows = rows.join(held, ["node", "component"]).join(still, "node")
    # A component of more than a part has parts of its own; the others share some, with alike sizes together.
    own = F.col("n") > most
    band = F.when(own | (F.col("rest") > most), F.floor(3 * F.log2("n_shingles"))).otherwise(0).alias("band")
    rows = rows.select("node", "rep", "n_shingles", own.alias("own"), F.when(own, F.col("component")).otherwise(0).alias("owner"), band)
    # A part is bounded by its number of sets and by their shingles.
    cells = rows.groupBy("node", "own", "owner", "band").agg(F.ceil(F.greatest(F.count("*") / most, F.sum("n_shingles") / PART)).alias("parts"))
    name = F.xxhash64("node", "own", "owner", "band", F.pmod(F.xxhash64("rep", "node"), "parts")).alias("part")
    keyed = rows.join(cells, ["node", "own", "owner", "band"]).select("node", "rep", "n_shingles", "own", "owner", name)
    keyed = storage.materialize(keyed, "parts")
    parts = keyed.groupBy("node", "part").agg(F.first("own").alias("own"), F.first("owner").alias("owner"), F.min("n_shingles").alias("lo"), F.max("n_shingles").alias("hi"))
    # The parts of one component skip each other, and so do parts of too different sizes.
    may = F.expr(f"a.node = b.node AND a.part <= b.part AND NOT (a.own AND b.own AND a.owner = b.owner) AND 100 * a.hi >= {percent} * b.lo AND 100 * b.hi >= {percent} * a.lo")
    pairs = parts.alias("a").join(parts.alias("b"), may).select(F.col("a.node").alias("node"), F.col("a.part").alias("x"), F.col("b.part").alias("y"), F.xxhash64("a.node", "a.part", "b.part").alias("pair"))
    ends = pairs.where("x <> y").select("node", "pair", F.explode(F.array("x", "y")).alias("part"))
    # A part that meets another is compared within itself there.
    alone = pairs.where("x = y").select("node", "pair", F.col("x").alias("part")).join(ends.select("node", "part").distinct(), ["node", "part"], "left_anti")
    ends = ends.unionByName(alone)
    return keyed.join(ends, ["node", "part"]).select(F.col("pair").alias("node"), "rep")


def _links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= percent * union."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    if m == 2:
        common = np.array([[size[0], 0], [0, size[1]]])
        common[0, 1] = common[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
    else:
        owner = np.repeat(np.arange(m), size)
        tokens, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = seen > 1
        column = np.where(shared, np.cumsum(shared) - 1, -1)[column]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        common = np.zeros((m, m))
        for a in range(0, int(shared.sum()), 4096):
            lo, hi = np.searchsorted(column, [a, a + 4096])
            block = np.zeros((m, 4096), np.float32)
            block[owner[lo:hi], column[lo:hi] - a] = 1
            common += block @ block.T
        common = np.rint(common).astype(np.int64)
        np.fill_diagonal(common, size)
    linked = 100 * common >= percent * (size[:, None] + size[None, :] - common)
    out, todo = [], np.ones(m, bool)
    for i in range(m):
        if todo[i]:
            todo[i] = False
            edge = [i]
            while edge:
                new = linked[edge.pop()] & todo
                todo &= ~new
                found = np.flatnonzero(new).tolist()
                out += [(j, i) for j in found]
                edge += found
    return out


def links(docs: DataFrame, classes: DataFrame, nodes: DataFrame, *, words: int, percent: int, few: int = 0) -> DataFrame:
    """(a, b) pairs of representatives whose components are those of all links within the nodes (node, rep).

    A set goes to its nodes from the task that reads its text. Up to ``few`` representatives are
    looked for by a broadcast of their ids, more by a join that shuffles the texts.
    """
    wanted = nodes.groupBy("rep").agg(F.collect_set("node").alias("nodes"))
    wanted = classes.select("rep", "c1", "c2").join(wanted, "rep")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(rep, pa.int64()), pa.array(tokens, pa.binary())], ["node", "rep", "tokens"])

        node, rep, tokens, held = [], [], [], 0
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), _sets(batch.column(0), words), strict=True)
            for r, c1, c2, at, s in rows:
                if len(s) and _class_name(s) == [c1, c2]:
                    raw = s.tobytes()
                    for n in at:
                        node.append(n)
                        rep.append(r)
                        tokens.append(raw)
                        held += len(raw)
                        if held > BATCH:
                            yield done()
                            node, rep, tokens, held = [], [], [], 0
        yield done()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reps, held = None, [], []

        def done() -> pa.RecordBatch:
            found = _links(held, percent) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([reps[i] for i, _ in found], pa.int64()), pa.array([reps[j] for _, j in found], pa.int64())], ["a", "b"])

        for batch in batches:
            for node, rep, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if node != now:
                    if len(held) > 1:
                        yield done()
                    now, reps, held = node, [], []
                elif rep == reps[-1]:
                    continue  # a repeated row
                reps.append(rep)
                held.append(np.frombuffer(raw, np.uint64))
        if len(held) > 1:
            yield done()

    storage.small_batches(docs.sparkSession, 256)
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text")
    ids = nodes.select("rep").distinct()
    if few and ids.limit(few + 1).count() <= few:
        texts = texts.join(F.broadcast(ids), "rep", "left_semi")
    rows = texts.join(wanted, "rep").select("text", "rep", "c1", "c2", "nodes").mapInArrow(spread, "node long, rep long, tokens binary")
    return rows.repartition("node").sortWithinPartitions("node", "rep").mapInArrow(compare, "a long, b long")


def groups(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT, trees: int = TREES, keep: int = KEEP, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    rows = storage.materialize(_sketches(docs, words, trees, keep), "sketches")
    whole = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = storage.materialize(whole.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.first("paths").alias("paths"), F.first("n_shingles").alias("n_shingles")), "classes")
    # Rows with one doc_id and different texts are one document.
    same_id = whole.groupBy("doc_id").agg(F.min("c1").alias("x"), F.max("c1").alias("y")).where("x <> y").select("doc_id")
    twice = whole.join(same_id, "doc_id").select("doc_id", "c1", "c2").join(classes.select("c1", "c2", "rep"), ["c1", "c2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    nodes, dense = _nodes(classes, trees, keep, limit)
    if dense is not None:
        dense = storage.materialize(dense, "dense")
        nodes = nodes.unionAll(_thinned(dense, limit))
    # Nodes of several trees with the same members are compared once.
    members = nodes.groupBy("node").agg(F.sort_array(F.collect_set("rep")).alias("members"))
    alike = members.groupBy("members").agg(F.min("node").alias("node")).where("size(members) > 1")
    nodes = storage.materialize(alike.select("node", F.explode("members").alias("rep")), "nodes")
    component = components.smallest_reachable(links(docs, classes, nodes, words=words, percent=percent).unionAll(twice))
    if dense is not None:
        pairs = _open_pairs(dense, classes, component, percent=percent, limit=limit)
        if pairs is not None:
            pairs = storage.materialize(pairs, "pairs")
            more = storage.materialize(links(docs, classes, pairs, words=words, percent=percent, few=FEW), "links")
        if pairs is not None and not more.isEmpty():
            component = components.smallest_reachable(component.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more))
    named = classes.join(component, classes["rep"] == component["node"], "left").select("c1", "c2", F.coalesce("component", "rep").alias("component"))
    out = rows.drop("paths").join(named, ["c1", "c2"], "left")
    ids = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
    out = out.select("doc_id", "n_shingles", ids)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_copies(docs: DataFrame, **how) -> DataFrame:
    """The rows and columns of one document of each group; repeated rows of it once."""
    kept = groups(docs, **how).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_kept")).distinct()
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(whole, F.col("doc_id").cast("long").alias("_kept"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    stay = rows.join(kept, "_kept", "left_semi").dropDuplicates(["_kept", "digest"]).select("row")
    return stay.unionAll(rows.where("_kept IS NULL").select("row")).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
