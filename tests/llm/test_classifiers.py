import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from caselens.llm import isotonic, quality, toxicity


def corpus(spark, n=600):
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "river", "stone", "cloud", "green"]
    rows, labels = [], []
    for i in range(n):
        good, toxic = i % 3 != 0, i % 5 == 0
        w = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        if toxic:
            w[2] = rng.choice(["dreadful", "horrid"])
        if not good:
            w = [x + "$$$" for x in w]
        rows.append((i, " ".join(w), "en", i % 7))
        labels.append((i, int(good), int(toxic)))
    rows += [(n, None, None, 1), (n + 1, "", "en", 2), (0, rows[0][1], "en", 3), (None, "loose text", "en", 4)]
    labels += [(n, None, None), (5, 1, 1), (99999, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, y int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), n


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0


def test_quality_scores(spark):
    docs, labels, n = corpus(spark)
    got = quality.scores(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(0 <= r.score <= 1 and r.held_out == held(r.doc_id) and r.predicted == (r.score >= 0.3) for r in got)
    test = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < n]
    assert np.mean([r.predicted == (r.doc_id % 3 != 0) for r in test]) > 0.97
    again = {r.doc_id: r.score for r in quality.scores(docs.drop("lang").repartition(3), labels).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 for r in got)
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns and kept.where("text LIKE '%$$$%'").count() == 0
    assert quality.scores(docs.where("false"), labels).count() == 0
    assert {r.score for r in quality.scores(docs.limit(5), labels.where("false")).collect()} == {0.5}


def test_quality_equals_a_plain_fit(spark):
    # Ridge on the same waves by one dense solve, and pooled adjacent violators on the same bins.
    docs, labels, n = corpus(spark, 200)
    rows = docs.collect()
    stats = quality.statistics(pa.array([r.text for r in rows], pa.string()))
    mean, spread = stats.mean(0), np.sqrt(np.maximum(stats.var(0), 1e-8))
    rng = np.random.default_rng(7)
    w, b = rng.normal(size=(stats.shape[1], quality.FEATURES)) / np.sqrt(stats.shape[1]), rng.uniform(0, 2 * np.pi, quality.FEATURES)
    x = np.hstack([np.cos(np.clip((stats - mean) / spread, -6, 6) @ w + b) * np.sqrt(2 / quality.FEATURES), np.ones((len(rows), 1))])
    known = {}
    for r in labels.collect():
        if r.quality in (0, 1) and not held(r.doc_id):
            known[r.doc_id] = max(r.quality, known.get(r.doc_id, 0))
    at = [i for i, r in enumerate(rows) if r.doc_id in known]
    y = np.array([known[rows[i].doc_id] for i in at], float)
    d = x.shape[1]
    beta = np.linalg.solve(x[at].T @ x[at] / len(at) + quality.RIDGE * np.diag([*np.ones(d - 1), 0]) / d, x[at].T @ y / len(at))
    raw = x @ beta
    bins = isotonic.bin_of(raw, -0.5, 1.5)
    total, positive = np.bincount(bins[at], minlength=isotonic.BINS), np.bincount(bins[at], y, isotonic.BINS)
    levels = isotonic.pool(total, positive)
    want = {(r.doc_id, r.text): levels[k] for r, k in zip(rows, bins, strict=True)}
    got = quality.scores(docs, labels).collect()
    close = [min(abs(r.score - s) for (i, _), s in want.items() if i == r.doc_id) for r in got]
    # A raw score on the edge of a bin may fall to either side in another order of summing.
    assert np.mean(np.array(close) < 1e-9) > 0.98


def test_toxicity_scores(spark):
    docs, labels, n = corpus(spark)
    got = toxicity.scores(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(0 <= r.score <= 1 and r.held_out == held(r.doc_id) and r.predicted == (r.score >= 0.5) for r in got)
    test = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < n]
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in test]) > 0.97
    assert all(not held(e) for r in got for e in r.evidence)
    assert toxicity.scores(docs.where("false"), labels).count() == 0
    assert {r.score for r in toxicity.scores(docs.limit(5), labels.where("false")).collect()} == {0.5}


def test_toxicity_covers_texts_without_the_leading_terms(spark):
    # Each of 300 words goes with the label too seldom to be among few leading terms.
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(1200):
        side = "bad" if i % 2 else "good"
        rows.append((i, " ".join(f"{rng.randrange(300)}{side}" for _ in range(12))))
        labels.append((i, 1, i % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, index, every = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert every.where("size(terms) = 0").count() == 0
    assert abs(index.labels[: len(index.labels) // 2].mean() - 0.5) < 0.25


def test_toxicity_equals_a_plain_version(spark):
    # TF-IDF, likelihood ratios, cosines, votes and calibration anew, over the whole vocabulary.
    docs, labels, n = corpus(spark, 200)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    known = {}
    for r in labels.collect():
        if r.toxic in (0, 1) and not held(r.doc_id):
            known[r.doc_id] = max(r.toxic, known.get(r.doc_id, 0))
    words = lambda t: collections.Counter(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)))
    sample = {}
    for i, t in rows:
        if i in known:
            sample[i] = max(sample.get(i, ""), t)
    bags = {i: words(t) for i, t in sample.items()}
    n1, n0 = sum(known[i] for i in sample), sum(1 - known[i] for i in sample)

    def ratio(a, b):
        part = lambda k, m, p: (k * np.log(k / (m * p)) if k else 0.0) + ((m - k) * np.log((m - k) / (m * (1 - p))) if m > k else 0.0)
        p = (a + b) / (n1 + n0)
        return 2 * (part(a, n1, p) + part(b, n0, p)) if p < 1 else 0.0

    weigh = {}
    for w in {w for b in bags.values() for w in b}:
        a, b = sum(w in bags[i] and known[i] for i in bags), sum(w in bags[i] and not known[i] for i in bags)
        if a + b >= 2:
            weigh[w] = np.log(1 + len(rows) / (1 + sum(w in words(t) for _, t in rows))) * (1 + max(ratio(a, b), 0.0))

    def vector(bag):
        v = {w: (1 + np.log(k)) * weigh[w] for w, k in bag.items() if w in weigh}
        norm = sum(x * x for x in v.values()) ** 0.5
        return {w: x / norm for w, x in v.items()}

    _, index, _ = toxicity.fit(docs, labels)
    order = index.ids.tolist()
    vectors = {i: vector(bags[i]) for i in order}
    rates = {1: sum(known.values()) / n1, 0: sum(1 - y for y in known.values()) / n0}

    def near(v, without=None):
        s = [(-round(sum(x * vectors[i].get(w, 0.0) for w, x in v.items()), 12), k, i) for k, i in enumerate(order) if i != without]
        return [(i, -c) for c, _, i in sorted(s)[: toxicity.NEIGHBOURS] if c < 0]

    def vote(found):
        total = sum(rates[known[i]] * c for i, c in found)
        return sum(rates[known[i]] * c * known[i] for i, c in found) / total if total else -1.0

    total, positive = np.zeros(isotonic.BINS), np.zeros(isotonic.BINS)
    for i in order:
        if (raw := vote(near(vectors[i], i))) >= 0:
            b = min(int(raw * isotonic.BINS), isotonic.BINS - 1)
            total[b] += rates[known[i]]
            positive[b] += rates[known[i]] * known[i]
    levels = isotonic.pool(total, positive)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    for r in toxicity.scores(docs, labels).collect():
        want = []
        for t in texts[r.doc_id]:
            found = near(vector(words(t)))
            raw = vote(found)
            want.append((levels[min(int(raw * isotonic.BINS), isotonic.BINS - 1)] if raw >= 0 else index.plain, [i for i, _ in found[:5]]))
        assert any(abs(r.score - s) < 1e-9 and r.evidence == e for s, e in want)


def test_block_max_search_is_exact():
    rng = np.random.default_rng(5)
    index = toxicity.Index(rng.uniform(0.5, 3, 30), np.zeros(300), np.ones(300), np.arange(300), np.zeros(isotonic.BINS), 0.0)
    vectors = []
    for _ in range(300):
        t = np.sort(rng.choice(30, rng.integers(1, 6), replace=False))
        vectors.append(index.vector(t, rng.integers(1, 4, len(t))))
    index.build(vectors)
    dense = np.zeros((300, 30))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for i in range(50):
        t, w = vectors[i]
        near, cosine = index.nearest(t, w, 7, without=i)
        s = np.round(dense @ dense[i], 12)
        s[i] = -1
        want = [j for j in np.lexsort((np.arange(300), -s))[:7] if s[j] > 0]
        assert near.tolist() == want and np.allclose(cosine, s[want])


def test_isotonic_is_monotone_and_pools():
    total, positive = np.zeros(isotonic.BINS), np.zeros(isotonic.BINS)
    for b, n, p in ((10, 10, 1), (20, 10, 6), (30, 10, 4), (40, 10, 9)):
        total[b], positive[b] = n, p
    level = isotonic.pool(total, positive)
    assert (np.diff(level) >= 0).all() and level[20] == level[30] or abs(level[25] - 10.5 / 21) < 1e-9
    assert (isotonic.pool(np.zeros(8), np.zeros(8)) == 0.5).all()
