import random
import zlib
from collections import Counter

import regex

from caselens.llm import fm_index


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, least=5, one_in=199):
    count = Counter()
    for i, text in rows:
        for run in regex.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                count[run] += 1
    count = {w: n for w, n in count.items() if n >= least}
    out = {}
    for w, n in count.items():
        beside = sorted((-m, x) for x, m in count.items() if near(w, x))
        form = beside[0][1] if beside and -beside[0][0] >= 5 * n else None
        out[w] = [form, n, len(beside), count.get(form)]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        yield w, row[0], root, *row[1:]


def texts(n=300, seed=1):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("aeéntßrs") for _ in range(rng.randint(5, 9))) for _ in range(60)]

    def word():
        w = stems[min(int(rng.expovariate(0.12)), 59)]
        k = rng.randrange(len(w))
        w = rng.choice([w] * 9 + [w[:k] + w[k + 1 :], w[:k] + "x" + w[k:], w[:k] + "É" + w[k + 1 :]])
        return rng.choice([w, w.upper(), w.title()])

    return [(i % 250 if i else None, " ".join(word() + rng.choice(["", ",", "-b", "1"]) for _ in range(rng.randint(0, 60)))) for i in range(n)]


def test_variants_equal_brute_force(spark):
    rows = [*texts(), (7, None), (8, ""), (9, "þórðurs " * 4000 + "×÷×÷×÷ " * 9), (9, "naturelles " * 20 + "naturellés naturelle " * 4)]
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(4)
    want = sorted(brute(rows, one_in=7), key=str)
    assert {bool(r[1]) for r in want} == {True, False} and any(r[1] != r[2] and r[1] for r in want)
    for how in ({}, {"block": 16, "hot": 6}):
        got = fm_index.variants(df, one_in=7, **how)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_long_chains_of_forms(spark):
    chain = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb", "aabbbb"]
    links = spark.createDataFrame([(a, b) for a, b in zip(chain, chain[1:], strict=False)], "word string, form string")
    assert {tuple(r) for r in fm_index._roots(links).collect()} == {(a, chain[-1]) for a in chain[:-1]}


def test_no_words(spark):
    df = spark.createDataFrame([(1, None), (2, "short words only")], "doc_id long, text string")
    assert fm_index.variants(df).count() == 0 and fm_index.variants(df.where("false")).count() == 0


def test_common_half_is_cut_into_bounded_blocks(spark):
    rng = random.Random(2)
    words = sorted({"interna" + "".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(900)})
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    got = {(r.word, r.near) for r in fm_index.pairs_one_edit_apart(df, block=200, hot=100).collect()}
    assert got == {(a, b) for a in words for b in words if near(a, b)}


def test_index_against_plain_edits():
    rng = random.Random(5)
    data = sorted({"".join(rng.choice("abß") for _ in range(rng.randint(6, 9))) for _ in range(500)})
    asking = [*data, "zzzzzz", "aaaaaz", "ababab"]
    got = {(asking[i], data[j]) for a, b in fm_index.near_pairs(data, asking) for i, j in zip(a, b, strict=True)}
    assert got == {(a, b) for a in asking for b in data if near(a, b)}
    assert list(fm_index.near_pairs([], asking)) == []
    assert [x for a, _ in fm_index.near_pairs(["abcdef"], ["abcdef", "abcdeg"]) for x in a] == [1]


def test_intervals_count_matches():
    words = ["banana", "bananas", "cabana"]
    index = fm_index.Index(words)
    state = index.everything(1)
    for c in "nana":
        state = index.extend(state, index.codes([c])[0], True)
    assert state.size.tolist() == [2]  # in banana and bananas
    state = index.extend(state, index.codes(["a"])[0], False)
    assert state.size.tolist() == [2]
    assert index.extend(state, 0, True).size.tolist() == [1]  # banana ends there
