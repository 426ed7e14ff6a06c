import hashlib
import math

from caselens.llm import digest as D

TEXTS = ["", None, "a", "ab", "The quick brown fox jumps over the lazy dog. " * 9, "é" * 7, "The quick brown fox jumps over the lazy dog. " * 9, "Something else entirely, with other words in it; numbers 12345 too.", "x" * 50_000]


def test_neighbours_and_edits(spark):
    ids = [10, 20, 20, 30, 41, 50, 60, 70, 80]
    rows = sorted(zip(ids, TEXTS, strict=True), key=lambda r: (r[0], r[1] is not None, r[1] or ""))
    docs = spark.createDataFrame([(i, t, "r", 1) for i, t in rows], "doc_id long, text string, r string, tail int").repartition(4)
    got = D.neighbour_fingerprints(docs).collect()
    want = set()
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(t) // 4
        e = t[: len(t) - n] + nxt[:n]
        a, b, c = (D.codes(x.encode()) for x in (t, e, nxt))
        want.add((i, len(t), hashlib.sha256(e.encode()).hexdigest(), D.encode(a), D.encode(b), D.likeness(a, b), D.likeness(a, c)))
    assert set(map(tuple, got)) == want and len(got) == len(rows)
    assert len({r.fingerprint for r in got if r.doc_id in (41, 60)}) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_single_row_null_id_and_empty(spark):
    one = spark.createDataFrame([(None, "abcdefgh")], "doc_id long, text string")
    r = D.neighbour_fingerprints(one).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and r.near_next == 1.0
    assert D.neighbour_fingerprints(one.where("false")).count() == 0 and D.fingerprints(one).count() == 1


def test_digests_round_trip_and_rank():
    a = D.codes(TEXTS[4].encode())
    assert (D.decode(D.encode(a)) == a).all() and D.likeness(a, a) == 1
    near, far = D.codes((TEXTS[4] + "!").encode()), D.codes(TEXTS[7].encode())
    assert D.likeness(a, near) > 0.9 > D.likeness(a, far)


def plain_digest(text):
    """The digest anew, triplet by triplet."""
    data = text.encode()
    if not data:
        return "00" + "00" * (D.BUCKETS // 4)
    data += bytes(2)
    count = [0] * D.BUCKETS
    for i in range(len(data) - 2):
        v = data[i] | data[i + 1] << 8 | data[i + 2] << 16
        count[(v * 2654435761 & 0xFFFFFFFF) >> (33 - D.BUCKETS.bit_length())] += 1
    cuts = [sorted(count)[D.BUCKETS * q // 4 - 1] for q in (1, 2, 3)]
    quartile = [sum(n > c for c in cuts) for n in count]
    size = len(text.encode())
    step = min(255, 1 + int(8 * math.log2(size)))
    return bytes([step, *(sum(quartile[i + j] << 2 * j for j in range(4)) for i in range(0, D.BUCKETS, 4))]).hex()


def test_digests_equal_a_plain_version():
    for t in TEXTS:
        assert D.encode(D.codes((t or "").encode())) == plain_digest(t or "")
    a, b = (D.codes(TEXTS[i].encode()) for i in (4, 7))
    apart = sum((0, 1, 2, 6)[abs(int(x) - int(y))] for x, y in zip(a[:-1], b[:-1], strict=True)) + max(0, abs(int(a[-1]) - int(b[-1])) - 4)
    far = min(0.8 * D.BUCKETS, sum((0, 1, 2, 6)[x] for x in [*a[:-1].tolist(), *b[:-1].tolist()]))
    assert abs(D.likeness(a, b) - max(0.0, 1 - apart / far)) < 1e-12


def test_short_unrelated_texts_are_not_alike():
    a, b, again = (D.codes(x) for x in (b"quick brown", b"lazy dogs!?", b"quick brawn"))
    assert D.likeness(a, b) < 0.1 and D.likeness(a, again) > D.likeness(a, b) and D.likeness(D.codes(b""), a) == 0
