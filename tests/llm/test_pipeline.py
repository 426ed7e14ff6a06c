import collections
import zlib

import numpy as np

import corpus_pipeline
from caselens.llm import mixing, pii_crf, quality, storage, tokens

from test_near_copies import brute

DATA = "/root/testdata/sf0.001"


def test_every_stage_equals_a_plain_version(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = spark.createDataFrame([(900001, None, "en", None, 0), (900002, "", "en", "src1", 0), (900003, "mail me at some.one@example.org or at some.one@example.org", None, "src2", 58), (900003, "mail me at some.one@example.org or at some.one@example.org", None, "src2", 58), (None, "a text without an id but with words", "en", "src2", 34)], docs.schema)
    docs = storage.materialize(docs.unionAll(extra), "test")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    columns, stages, at = docs.columns, dict(corpus_pipeline.STAGES), {"start": docs}
    assert list(stages) == ["quality", "near_copies", "personal_data", "mixing", "packing"]
    for name in list(stages)[:-1]:
        before = at[list(at)[-1]]
        at[name] = storage.materialize(stages[name](spark, before, DATA), f"test-{name}")
        assert at[name].columns == columns and dict(at[name].dtypes) == dict(docs.dtypes)
    rows = {n: [tuple(r) for r in d.collect()] for n, d in at.items()}
    i, t = columns.index("doc_id"), columns.index("text")

    # Quality: the rows whose score reaches the threshold, with their repeats.
    good = collections.Counter()
    for r in quality.scores(docs, labels).collect():
        good[r.doc_id] += r.predicted
    assert collections.Counter(r[i] for r in rows["quality"]) == +good

    # Near-copies: the smallest of each group by all pairs of five-word sets; a row without an id stays.
    group = brute([(r[i], r[t]) for r in rows["quality"]], 5, 80)
    assert sorted(r[i] for r in rows["near_copies"] if r[i] is not None) == sorted({g for g in group.values()})
    assert sum(r[i] is None for r in rows["near_copies"]) == sum(r[i] is None for r in rows["quality"])

    # Personal data: no base span is left, and texts without any are as they were.
    was = {r[i]: r[t] for r in rows["near_copies"]}
    assert sorted(map(str, was)) == sorted(str(r[i]) for r in rows["personal_data"])
    for r in rows["personal_data"]:
        assert not pii_crf.base_spans(r[t] or "")
        if not pii_crf.nodes(was[r[i]] or "")[1]:
            assert r[t] == was[r[i]]

    # Mixing: every row as often as the mix takes it.
    times = collections.Counter()
    for r in mixing.draws(at["personal_data"]).collect():
        times[r.doc_id] += len(r.shards)
    assert collections.Counter(r[i] for r in rows["mixing"]) == +times

    # Packing: each copy's pieces are its ids, and pieces tile their sequences.
    packed = stages["packing"](spark, at["mixing"], DATA).collect()
    enc = tokens.encoder(tokens.default_vocabulary())
    want = collections.Counter()
    for r in rows["mixing"]:
        ids = enc.encode(r[t] or "") + np.array([0], "<u4").tobytes()
        for k, a in enumerate(range(0, len(ids), 4 * 2048)):
            want[r[i], k, zlib.crc32(ids[a : a + 4 * 2048])] += 1
    assert collections.Counter((r.doc_id, r.piece, r.ids_crc32) for r in packed) == want
    places = collections.defaultdict(list)
    for r in packed:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        ends = np.cumsum([n for _, n in sorted(p)])
        assert [o for o, _ in sorted(p)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048


def test_an_empty_table_passes_every_stage(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0
