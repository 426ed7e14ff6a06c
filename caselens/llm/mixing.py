"""Mixing sources to target weights by a splitting tree (operator 8, DataFrame functions only).

Every document has a pseudo-random rank from its content and the seed; the top
bits of the rank are its block, so a source's blocks are already in random
order. A source's target is filled by whole passes over it and, for the rest,
by its lowest-ranked documents up to a threshold: whole blocks, then whole
parts of the block at the boundary, then documents of one part. The drawn
blocks of all sources are dealt to output shards by a binary tree: each node
splits its sources' exact block quotas between its two children by one
multivariate hypergeometric draw, and each leaf takes disjoint blocks in
permuted order. Within a shard, documents follow a seeded order.

A source has at most BLOCKS blocks, so the tables of blocks and quotas depend
on the number of sources alone. Documents are never grouped by source: sums are
pre-aggregated in tasks, and the small tables are broadcast only if Spark finds
their files under its threshold.

Defined results: a null text has size 0; a null source is a source of its own,
after all others; repeated rows share a rank and are taken or left together;
null doc_id are documents like any other; where all sizes are 0 nothing is
taken; an empty table gives no rows; other columns are ignored or kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import storage

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_TIMES = 2
SHARDS = 32
BLOCKS_BITS = 7
BLOCKS = 1 << BLOCKS_BITS
PARTS_BITS = 8
RANK_BITS = 52


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _rank(seed: int) -> Column:
    """52 pseudo-random bits; null fields count as a value of their own."""
    hashed = F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1)), F.col("doc_id").isNull(), F.coalesce("text", F.lit("")), F.coalesce("source", F.lit("")))
    return F.shiftrightunsigned(hashed, 64 - RANK_BITS)


def _ranked(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count("text").alias("size"), _rank(seed).alias("rank"))


def targets(sizes: DataFrame, *, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_TIMES) -> DataFrame:
    """From (source, source_size): each source's number in order, target, whole passes and rest.

    A target is level * weight, held at ``most`` times the size; the level is
    the one at which the targets add up. Sources are walked by the level that
    fills them: the first that stays below its own filling level sets it.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("number", F.row_number().over(order) - 1).withColumn("weight", F.get(cycle, F.col("number") % len(weights)))
    s = s.withColumn("cap", (F.col("source_size") * most).cast("double")).withColumn("full_at", F.col("cap") / F.col("weight"))
    by = W.orderBy("full_at", "number")
    s = s.withColumn("all", F.sum("source_size").over(W.partitionBy()).cast("double") * share)
    s = s.withColumn("spent", F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("open", F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing)))
    s = s.withColumn("level", (F.col("all") - F.col("spent")) / F.col("open"))
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "number", "level"))).over(W.partitionBy())["level"])
    s = s.withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))))
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("int")
    s = s.withColumn("passes", passes)
    return s.select("source", "source_size", "number", "target", "passes", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size")).alias("rest"))


def _boundary(sums: DataFrame, key: str) -> DataFrame:
    """Of (number, key, words, rest): running sums by key, and the first key where they pass the rest."""
    upto = F.sum("words").over(W.partitionBy("number").orderBy(key).rowsBetween(W.unboundedPreceding, 0))
    return sums.withColumn("upto", upto).where(F.col("upto") > F.col("rest")).groupBy("number").agg(F.min(key).alias(key), F.min_by(F.col("rest") - (F.col("upto") - F.col("words")), key).alias("rest"))


def _join_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    s = sources.withColumnRenamed("source", "_source")
    return rows.join(s, rows["source"].eqNullSafe(s["_source"]), "inner").drop("_source")


_HYPERGEOMETRIC = """
CASE WHEN greatest(0L, s.draw - (s.pool - x.q)) >= least(x.q, s.draw) THEN least(x.q, s.draw) ELSE
  aggregate(sequence(greatest(0L, s.draw - (s.pool - x.q)), least(x.q, s.draw)),
    named_struct('w', 1D, 'sum', 0D, 'k', cast(null AS BIGINT)),
    (t, k) -> named_struct('w', t.w * ((x.q - k) * (s.draw - k)) / ((k + 1) * (s.pool - x.q - s.draw + k + 1)), 'sum', t.sum + t.w,
      'k', CASE WHEN t.k IS NULL AND t.sum + t.w >= x.u * aggregate(sequence(greatest(0L, s.draw - (s.pool - x.q)), least(x.q, s.draw)),
        named_struct('w', 1D, 'sum', 0D), (a, j) -> named_struct('w', a.w * ((x.q - j) * (s.draw - j)) / ((j + 1) * (s.pool - x.q - s.draw + j + 1)), 'sum', a.sum + a.w)).sum
        THEN k ELSE t.k END)).k
END"""


def _split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """From (number, q): (number, shard, q) by the splitting tree; shards' totals differ by one at most."""
    item = F.struct("number", "q")
    nodes = quotas.groupBy().agg(F.sort_array(F.collect_list(item)).alias("quotas")).select(F.lit(0).alias("node"), F.lit(shards).alias("width"), "quotas")
    u = "shiftrightunsigned(xxhash64({seed}, node, width, v.number), 11) / 9007199254740992D"
    for level in range((shards - 1).bit_length()):
        drawn = nodes.withColumn("total", F.expr("aggregate(quotas, 0L, (a, v) -> a + v.q)")).withColumn("half", F.expr("width div 2"))
        drawn = drawn.withColumn("keyed", F.expr(f"transform(quotas, v -> named_struct('q', v.q, 'u', {u.format(seed=seed + level)}))"))
        drawn = drawn.withColumn("take", F.expr("CASE WHEN width = 1 THEN total ELSE (total * half) div width END"))
        drawn = drawn.withColumn(
            "left",
            F.expr(
                "aggregate(keyed, named_struct('pool', total, 'draw', take, 'out', cast(array() AS ARRAY<BIGINT>)), (s, x) -> "
                f"get(transform(array({_HYPERGEOMETRIC}), h -> named_struct('pool', s.pool - x.q, 'draw', s.draw - h, 'out', array_append(s.out, h))), 0)).out"
            ),
        )
        pair = "named_struct('number', v.number, 'q', {})"
        left = f"named_struct('node', node * 2, 'width', greatest(half, 1), 'quotas', transform(quotas, (v, i) -> {pair.format('get(left, i)')}))"
        right = f"named_struct('node', node * 2 + 1, 'width', width - half, 'quotas', transform(quotas, (v, i) -> {pair.format('v.q - get(left, i)')}))"
        nodes = drawn.select(F.expr(f"inline(CASE WHEN width = 1 THEN array(named_struct('node', node * 2, 'width', 1, 'quotas', quotas)) ELSE array({left}, {right}) END)"))
    return nodes.select(F.dense_rank().over(W.orderBy("node")).alias("shard"), F.expr("inline(quotas)")).withColumn("shard", F.col("shard") - 1)


def plan(docs: DataFrame, *, seed: int = 0, shards: int = SHARDS, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_TIMES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ranked documents, sources with threshold, blocks with the shard of each copy)."""
    ranked = storage.materialize(_ranked(docs, seed), "ranked")
    sums = ranked.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = storage.materialize(targets(sums, weights=weights, share=share, most=most), "sources")

    block = F.shiftright("rank", RANK_BITS - BLOCKS_BITS).cast("int")
    part = F.shiftright("rank", RANK_BITS - BLOCKS_BITS - PARTS_BITS).bitwiseAND(F.lit((1 << PARTS_BITS) - 1)).cast("int")
    placed = _join_sources(ranked, sources).withColumn("block", block).withColumn("part", part)
    blocks = storage.materialize(placed.groupBy("number", "block").agg(F.sum("size").alias("words"), F.first("passes").alias("passes"), F.first("rest").alias("rest")), "blocks")
    edge = storage.materialize(_boundary(blocks, "block"), "edge")
    in_edge = placed.drop("rest").join(edge, ["number", "block"])
    parts = in_edge.groupBy("number", "part").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    inner = storage.materialize(_boundary(parts, "part"), "inner")
    in_part = in_edge.drop("rest").join(inner, ["number", "part"])
    upto = F.sum("size").over(W.partitionBy("number").orderBy("rank").rangeBetween(W.unboundedPreceding, 0))
    last = in_part.withColumn("upto", upto).where(F.col("upto") - F.col("size") / 2 <= F.col("rest")).groupBy("number").agg(F.max("rank").alias("last"))
    floor = inner.join(edge.select("number", "block"), "number").join(last, "number", "left")
    low = (F.col("block") * (1 << PARTS_BITS) + F.col("part")).cast("long") * (1 << (RANK_BITS - BLOCKS_BITS - PARTS_BITS)) - 1
    cut = floor.select("number", F.greatest(F.coalesce("last", low), low).alias("threshold"))
    cut = sources.join(cut, "number", "left").withColumn("threshold", F.when(F.col("rest") > 0, F.coalesce("threshold", F.lit((1 << RANK_BITS) - 1).cast("long"))).otherwise(F.lit(-1).cast("long")))
    cut = storage.materialize(cut.select("source", "source_size", "number", "target", "passes", "threshold"), "thresholds")

    reach = blocks.select("number", "block", "passes").join(cut.select("number", "threshold"), "number")
    partly = (F.col("block").cast("long") * (1 << (RANK_BITS - BLOCKS_BITS)) <= F.col("threshold")).cast("int")
    copies = reach.withColumn("copies", F.col("passes") + partly).where("copies > 0").select("number", "block", F.explode(F.expr("sequence(1, copies)")).alias("copy"))
    slot = F.row_number().over(W.partitionBy("number").orderBy(F.xxhash64(F.lit(seed + 101), "number", "block", "copy"), "block", "copy"))
    copies = copies.withColumn("slot", slot)
    leaves = _split_quotas(copies.groupBy("number").agg(F.count("*").alias("q")), shards, seed)
    before = F.coalesce(F.sum("q").over(W.partitionBy("number").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    dealt = leaves.withColumn("before", before).where("q > 0").select("number", "shard", F.explode(F.expr("sequence(cast(before + 1 AS INT), cast(before + q AS INT))")).alias("slot"))
    shard_of = copies.join(dealt, ["number", "slot"]).groupBy("number", "block").agg(F.sort_array(F.collect_list(F.struct("copy", "shard"))).alias("c"))
    return ranked, cut, storage.materialize(shard_of.select("number", "block", F.col("c.shard").alias("shards")), "shards")


def _drawn(ranked: DataFrame, cut: DataFrame, shard_of: DataFrame) -> DataFrame:
    block = F.shiftright("rank", RANK_BITS - BLOCKS_BITS).cast("int")
    rows = _join_sources(ranked, cut).withColumn("block", block)
    rows = rows.withColumn("times", F.col("passes") + (F.col("rank") <= F.col("threshold")).cast("int"))
    rows = rows.join(shard_of, ["number", "block"], "left")
    return rows.withColumn("shards", F.coalesce(F.slice("shards", 1, F.col("times")), F.expr("cast(array() AS ARRAY<INT>)")))


def draws(docs: DataFrame, **how) -> DataFrame:
    """What the mix takes of every document, and the shards its copies go to."""
    out = _drawn(*plan(docs, **how))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "shards")


def mix(docs: DataFrame, *, seed: int = 0, shards: int = SHARDS, **how) -> DataFrame:
    """The mixed corpus: documents' rows and columns, each as often as it is taken,
    dealt to shards and in seeded order within each."""
    _, cut, shard_of = plan(docs, seed=seed, shards=shards, **how)
    names = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("source").cast("string").alias("source"), _rank(seed).alias("rank"))
    out = _drawn(keyed, cut, shard_of).select("_row", "rank", F.posexplode("shards").alias("copy", "shard"))
    # A shard is a number of files that follows the session's partitions, so a task's part of the data needn't grow.
    parts = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = -(-parts // shards)
    out = out.withColumn("order", F.xxhash64(F.lit(seed + 202), "shard", "rank", "copy"))
    out = out.withColumn("file", F.pmod("order", F.lit(files)))
    return out.repartition(parts, "shard", "file").sortWithinPartitions("shard", "file", "order").select(*names)
