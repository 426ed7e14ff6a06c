import random
import re

import numpy as np
import pytest

from caselens.llm import mixing as M


def water(sizes, weights, share=1.5, most=2):
    goal, cap = share * sum(sizes), [most * s for s in sizes]
    target, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = goal
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total >= cap[i] - 1e-12]
        if not over:
            for i in open_:
                target[i] = left * weights[i] / total
            break
        for i in over:
            target[i] = cap[i]
            open_.discard(i)
        left = goal - sum(target)
    return target


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 30))), None if s == "z" else s, 1) for i in range(900) for s in [rng.choice(["a", "a", "a", "b", "ç", "d", "z"])]]
    rows += [(5000, None, "a", 1), (5001, "", "e", 1), (None, "some words", "b", 1), (7, rows[7][1], rows[7][2], 1), (7, rows[7][1], rows[7][2], 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, number int").repartition(3)


def test_targets_and_draws(docs):
    got = M.draws(docs).collect()
    rows = docs.collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({r.source for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(size(r.text) for r in rows if r.source == n) for n in names]
    want = dict(zip(sizes, water(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))]), strict=True))
    by = {}
    for r in got:
        assert abs(r.target - want[r.source_size]) < 1e-6 and r.taken <= 2 * r.size and r.taken == r.size * len(r.shards)
        by.setdefault(r.source_size, []).append(r.taken)
    assert all(abs(sum(v) - want[s]) <= 61 for s, v in by.items())
    assert sorted(map(str, got)) == sorted(map(str, M.draws(docs.repartition(5)).collect()))


def test_mix_repeats_rows_and_balances_shards(docs):
    taken = {(r.doc_id, r.size): len(r.shards) for r in M.draws(docs).collect()}
    out = M.mix(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(len(r.shards) for r in M.draws(docs).collect()) and taken
    assert M.mix(docs.where("false")).count() == 0 and M.draws(docs.where("false")).count() == 0


def test_quotas_split_exactly_and_without_bias(spark):
    quotas = spark.createDataFrame([(0, 90), (1, 30), (2, 7), (3, 0)], "number int, q long")
    left = []
    for seed in range(30):
        rows = M._split_quotas(quotas, 8, seed * 50).collect()
        for number, q in ((0, 90), (1, 30), (2, 7), (3, 0)):
            assert sum(r.q for r in rows if r.number == number) == q
        totals = [sum(r.q for r in rows if r.shard == s) for s in range(8)]
        assert max(totals) - min(totals) <= 1
        left.append(sum(r.q for r in rows if r.number == 0 and r.shard < 4))
    # Hypergeometric: 63 of 127 drawn, 90 of one kind; mean 44.6, deviation 2.6.
    assert abs(np.mean(left) - 44.6) < 4 * 2.6 / 30**0.5 and 1 < np.std(left) < 5


def test_native_plan(docs, capsys):
    M.draws(docs).explain("formatted")
    plan = capsys.readouterr().out
    assert not re.search("Python|Pandas|Arrow", plan)
