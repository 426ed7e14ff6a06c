import hashlib
import re

import numpy as np

from hypothesis import given, settings
from hypothesis import strategies as st

from caselens.llm import pii_crf as P


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 * (int(c) > 4)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    out = [(m.start(), 1, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 3, m.end()))
    out += [(m.start(), 4, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


@given(st.text(alphabet="ab@.1234567890 -+()é", max_size=80))
@settings(max_examples=600, deadline=None)
def test_base_spans_equal_the_patterns(text):
    assert P.base_spans(text) == plain(text)


def test_long_runs_are_linear():
    assert P.base_spans("a" * 300_000) == [] and P.base_spans("1" * 300_000) == [] and P.base_spans("a@" * 100_000) == []


TEXTS = [None, "", "call +1 (499) 555-6503 or mail ab.cd@mail.example.com now", "again 1 (499) 555-6503 and +1 (499) 555-6503, later 1 (499) 555-6503", "from 10.0.0.1 to 300.1.1.1", "card 4111 1111 1111 1111 é", "clean words only", "clean words only"]


def test_find_and_mask(spark):
    docs = spark.createDataFrame([(i, t, None if t is None else len(t), 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_chars long, base int")
    got = {r.doc_id: r for r in P.find(docs).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        base = plain(t or "")
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(P.written(base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == j for _, k, _ in base) for j in (1, 2, 3, 4))
        spans = set(filter(None, r.spans.split(",")))
        assert set(filter(None, P.written(base).split(","))) <= spans and len(spans) == len(base) + r.n_added
    masked = {r.doc_id: r for r in P.mask(docs).collect()}
    assert "[EMAIL]" in masked[2].text and "[PHONE]" in masked[2].text and masked[2].n_chars == len(masked[2].text)
    assert masked[6].text == TEXTS[6] and masked[0].text is None and masked.keys() == got.keys()
    assert P.find(docs.where("false")).count() == 0 and P.mask(docs.where("false")).count() == 0


def test_skip_edges_carry_labels():
    """A token that nothing but a similar one speaks for follows it over any distance."""
    text = "+1 (499) 555-6503 " + "word " * 200 + "x 499 555-6503 " + "word " * 200 + " 7 8"
    base, field = P.nodes(text)
    assert [k for _, k, _ in base] == [4]
    rows = [("shape", f[3], 0, 3) for f in field if f[1] < 0] + [("skip", 0, 1, 400)]
    model = P.potentials(rows)
    added = P.added_spans(field, model)
    assert [(text[a:b], k) for a, k, b in added] == [("499 555-6503", 4)]
    cut = P.Potentials(model.shape, model.chain, model.skip * 0)
    assert P.added_spans(field, cut) == []


def test_messages_give_exact_marginals_on_a_chain_and_near_ones_on_a_loop():
    import itertools

    rng = np.random.default_rng(4)
    k = len(P.LABELS)
    model = P.Potentials(np.log(rng.dirichlet(np.ones(k), P.SHAPES)), rng.normal(size=(k, k)) * 0.5, 1.0 * np.eye(k))
    for keys in ([[], [], [], []], [["a"], [], ["a"], []]):  # no skips: a tree; one skip: a loop of three
        field = [(10 * i, 3 if i == 3 else -1, 10 * i + 5, 7 * i + 1, keys[i]) for i in range(4)]
        left, right, skip = P._edges(field)
        want, total = np.zeros((4, k)), 0.0
        for y in itertools.product(range(k), repeat=4):
            if y[3] != 3:
                continue
            e = sum(model.shape[f[3], v] for f, v in zip(field[:3], y, strict=False))
            e += sum((model.skip if s else model.chain)[y[i], y[j]] for i, j, s in zip(left, right, skip, strict=True))
            total += np.exp(e)
            for i, v in enumerate(y):
                want[i, v] += np.exp(e)
        got = P.infer(field, model, rounds=200)
        assert np.abs(got - want / total).max() < (1e-3 if not any(keys) else 0.1)


def test_skips_carry_a_label_to_a_distant_like_token():
    chain = np.zeros((5, 5))
    shape = np.full((P.SHAPES, 5), np.log(0.05))
    shape[:, 0] = np.log(0.8)
    model = P.Potentials(shape, chain, 6.0 * np.eye(5))
    field = [(0, 4, 10, 1, ["d1234567"]), *((20 * i, -1, 20 * i + 5, 2, []) for i in range(1, 6)), (200, -1, 210, 3, ["d1234567"])]
    assert P.added_spans(field, model) == [(200, 4, 210)]


def test_edge_rows(spark):
    long = "x " * 200_000 + "a@b.cc " + "9" * 100_000
    rows = [(1, None), (1, None), (None, "mail a@b.cc"), (2, ""), (3, long)]
    docs = spark.createDataFrame([(i, t, "k", 0) for i, t in rows], "doc_id long, text string, spans string, n_email int")
    got = sorted(map(tuple, P.find(docs).select("doc_id", "n_email", "n_spans").collect()), key=str)
    assert got == sorted([(1, 0, 0), (1, 0, 0), (None, 1, 1), (2, 0, 0), (3, 1, 1)], key=str)
    assert P.find(docs.where("false")).count() == 0 and P.mask(docs).columns == docs.columns


def planted(seed, n):
    """Texts with first mentions that the recognisers see, later mentions that they don't, and decoys of
    the same shapes: (text, kind of each added span by start and stop, decoys as well with kind 0)."""
    rng = np.random.default_rng(seed)
    names = ["ann.lee", "bo_chan7", "cy.diaz", "dee.roy2", "eli-park9"]

    def number(k):
        return "".join(map(str, rng.integers(1, 10, k)))

    def card():
        head = number(15)
        return next(head + c for c in "0123456789" if luhn(head + c))

    def near(digits, form):
        return form.format(digits[:-7], digits[-7:-4], digits[-4:])

    out = []
    for _ in range(n):
        text, marks = "", []

        def put(word, piece, kind=None):
            nonlocal text
            text += " ".join(rng.choice(["the", "river", "of", "paper", "and", "seen", "light"], rng.integers(4, 30))) + f" {word} "
            if kind is not None:
                marks.append((len(text), kind, len(text) + len(piece)))
            text += piece + " "

        for what in rng.permutation(5):
            yes, word = bool(rng.integers(2)), str(rng.choice(["ref", "by", "then"]))
            if what == 0:  # a phone number, later without country code and in another form
                d = number(10)
                put("call", near(d, "+1 ({}) {}-{}") if yes else "seven")
                put(word, near(d, "{}-{}-{}"), 4 if yes else 0)
            elif what == 1:  # an address, later written out
                box = str(rng.choice(names))
                put("mail", f"{box}@host.example.org" if yes else "nobody")
                put(word, f"{box.upper()} (at) host dot example dot org", 1 if yes else 0)
            elif what == 2:  # a card number, later masked but for four digits
                d = card()
                put("card", d if yes else "none")
                put(word, f"****{d[-4:]}", 3 if yes else 0)
            elif what == 3:  # an address part, later in brackets
                four = ".".join(map(str, rng.integers(11, 250, 4)))
                put("host", four if yes else "none")
                put(word, four.replace(".", "[.]"), 2 if yes else 0)
            else:  # a number of a card's length that fails its check
                d = card()
                put("card", d[:-1] + str((int(d[-1]) + 1) % 10), 0)
        out.append((text, marks))
    return out


def measured(rows, model):
    """Precision and recall over the planted later mentions."""
    right = added = wanted = 0
    for text, marks in rows:
        base, field = P.nodes(text)
        true = {m for m in marks if m[1]}
        got = {(a, k, b) for a, k, b in P.added_spans(field, model)}
        right, added, wanted = right + len(got & true), added + len(got), wanted + len(true)
    return right / max(added, 1), right / wanted


def fitted(rows):
    table = {}
    for text, _ in rows:
        for e in P.counts(P.nodes(text)[1]):
            table[e] = table.get(e, 0) + 1
    return P.potentials([(*e, n) for e, n in table.items()])


def test_skips_decide_planted_mentions_on_held_out_rows():
    model = fitted(planted(1, 400))
    rows = planted(2, 200)
    precision, recall = measured(rows, model)
    assert precision >= 0.97 and recall >= 0.95
    assert measured(rows, P.Potentials(model.shape, model.chain, model.skip * 0, model.context))[1] <= 0.2


def test_numbers_that_fail_their_check_are_never_cards():
    text = "card 4111 1111 1111 1111 and card 4111 1111 1111 1112 or card 4111 1111 1111 1112"
    base, field = P.nodes(text)
    model = fitted([(text, [])] * 50)
    assert base == [(5, 3, 24)] and len(field) == 3 and P.added_spans(field, model) == []


def test_forms_of_one_thing_meet():
    keys = lambda text: [set(f.keys) for f in P.nodes(text)[1]]
    for text in ("ann.lee@host.org x Ann.Lee [at] host [dot] org", "ann.lee@host.org x ann.lee", "+1 (499) 555-6503 x 499 555 6503", "10.0.0.1 x 10[.]0[.]0[.]1", "4111111111111111 x xxxx-xxxx-xxxx-1111", "4111-1111-1111-1111 x 4111.1111.1111.1111"):
        got = keys(text)
        assert len(got) == 2 and got[0] & got[1], text
    assert P.nodes("we met at noon")[1] == [] and P.nodes("x" * 300_000 + " at " * 50_000)[1] == []
