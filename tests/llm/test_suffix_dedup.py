import collections
import hashlib
import random

import numpy as np

from caselens.llm import bytesops, suffix_dedup


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[s : s + length] for b in raw for s in range(len(b) - length + 1))
    out = []
    for b in raw:
        cover = []
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                if cover and s <= cover[-1][1]:
                    cover[-1][1] = s + length
                else:
                    cover.append([s, s + length])
        kept, at = b"", 0
        for a, e in cover:
            kept, at = kept + b[at:a], e
        kept += b[at:]
        out.append((len(b), len(b) - len(kept), len(cover), hashlib.sha256(kept).hexdigest()))
    return out


def check(got, rows, length, short):
    want = [(i, *x) for (i, _), x in zip(rows, brute([t for _, t in rows], length), strict=True)]
    assert sorted(map(str, (tuple(r)[:-1] for r in got))) == sorted(map(str, want))
    # Strings of ``short`` bytes that documents share are all noticed, those under a step less never.
    step = min(suffix_dedup.SHORT_STEP, short // 4)
    most, least = ({k: n for (i, t), n in zip(rows, shared(rows, m), strict=True) for k in [(i, hashlib.sha256((t or "").encode()).hexdigest())]} for m in (short - step + 1, short))
    for r in got:
        for (i, t) in rows:
            k = (i, hashlib.sha256((t or "").encode()).hexdigest())
            if i == r.doc_id and len((t or "").encode()) == r.n_bytes:
                assert (r.n_shared > 0) >= (least[k] > 0) and r.n_shared <= most[k]


def test_removals_equal_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rng.randint(10, 60))) for _ in range(6)]
    texts = [None, "", "short", "a" * 300, "ab" * 200 + "x", passages[0], passages[0]]
    for _ in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 4))]
        t = " ".join(parts)
        if rng.random() < 0.3:
            k = rng.randrange(len(t))
            t = t[:k] + "#" + t[k:]
        texts.append(t)
    texts += texts[-3:]
    ids = [None, *range(1, len(texts) - 3), 5, 6, 7]
    docs = spark.createDataFrame([(i, t, "n", 0) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, name string, spans int").repartition(4)
    rows = list(zip(ids, texts, strict=True))
    for length, gram, short in ((64, 16, 50), (40, 20, 30)):
        got = suffix_dedup.removals(docs, length=length, gram=gram, short=short, short_gram=12).collect()
        check(got, rows, length, short)


def shared(rows, length):
    """Bytes of each row that strings of ``length`` bytes cover which a row with another id holds."""
    raw = [(i, (t or "").encode()) for i, t in rows]
    holders = collections.defaultdict(set)
    for i, b in raw:
        for s in range(len(b) - length + 1):
            holders[b[s : s + length]].add(i)
    out = []
    for _, b in raw:
        hit = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if len(holders[b[s : s + length]]) > 1:
                hit[s : s + length] = True
        out.append(int(hit.sum()))
    return out


def test_one_leader_of_many_contents_spreads_and_stays_exact(spark, monkeypatch):
    # A line that all texts share leads windows whose surroundings differ, or repeat in a few texts.
    monkeypatch.setattr(suffix_dedup, "MANY", 8)
    rng = random.Random(9)
    line = "".join(rng.choice("xyz") for _ in range(50))
    noise = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    rest = [noise(60) for _ in range(4)]
    texts = [noise(rng.randint(20, 90)) + line + (rng.choice(rest) if rng.random() < 0.4 else noise(60)) + noise(30) for _ in range(300)]
    rows = list(enumerate(texts)) + [(3, texts[3] + "tail"), (None, texts[7] * 2), (None, texts[7][5:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = suffix_dedup.removals(docs, length=80, gram=20, short=64, short_gram=16).collect()
    check(got, rows, 80, 64)


def test_long_texts_are_ranked_in_stretches(monkeypatch):
    rng = np.random.default_rng(6)
    part = rng.integers(97, 101, 5000).astype(np.uint8)
    offs = np.array([0, 700, 700, 4200, 5000])
    runs = lambda: suffix_dedup.runs_of(part, offs, bytesops.prefix_hash(part), 60, 12)
    windows = lambda r: sorted((int(a), int(b + k), int(x), int(h)) for a, b, n, x, h in zip(*r, strict=True) for k in range(n))
    whole = windows(runs())
    monkeypatch.setattr(suffix_dedup, "PLACE_BITS", 10)
    assert [w[:2] for w in windows(runs())] == [w[:2] for w in whole] == [(r, s) for r in range(4) for s in range(offs[r], offs[r + 1] - 59)]


def test_order_is_made_again_where_hashes_disagree(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "suffix_sort", lambda text, prefix, starts, group, most: np.arange(len(starts)))
    flags = suffix_dedup.repeated_windows([b"bbbbbbbb", b"aaaaaaaa", b"bbbbbbbb"], [0, 0, 0], [1, 1, 1], np.zeros(3, np.int64), 8)
    assert [f.tolist() for f in flags] == [[True], [False], [True]]


def test_drop_repeats_keeps_columns(spark):
    p = "".join(chr(97 + i * i * 7 % 26) for i in range(90))
    docs = spark.createDataFrame([(1, "start é" + p + "end", 4), (2, p + "tail", 5), (3, None, 6)], "doc_id long, text string, n_chars int")
    got = {r.doc_id: (r.text, r.n_chars) for r in suffix_dedup.drop_repeats(docs, length=64, gram=16).collect()}
    assert got == {1: ("start éend", 4), 2: ("tail", 5), 3: (None, 6)}
    assert suffix_dedup.removals(docs.where("false")).count() == 0


def test_suffix_sort_orders_groups_by_bytes():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 100, 4000).astype(np.uint8)
    starts = rng.integers(0, 3900, 500)
    group = rng.integers(0, 7, 500)
    order = suffix_dedup.suffix_sort(text, bytesops.prefix_hash(text), starts, group, 64)
    keys = [(int(group[i]), text[starts[i] : starts[i] + 64].tobytes()) for i in order]
    assert keys == sorted(keys)
