"""Personal data by a skip-chain conditional random field (operator 1).

Four recognisers give base spans. The field's nodes are the base spans, held to
their kinds, and every other token that may be personal data: those with a
digit or an ``@``, addresses written out (``name (at) host dot net``), numbers
masked but for their last four digits, and bare mailbox names of addresses that
the document holds. Node potentials come from a token's shape (whether its
digits pass the check among it) and the word before it, chain potentials join
neighbours, and skip potentials join each repeated or similar token (same
digits, same last seven or masked last four, same address however written, same
mailbox) to the one before it in the document, however far away. Loopy
sum-product messages make the labels of such tokens agree; a token whose
likeliest label is a kind of personal data becomes a further span. A token that
occurs n times gives n - 1 skip edges, never all pairs.

A kind that a token cannot be (a card number failing its check, an address part
over 255) has no weight there. Open tokens are unlabelled, not known to be
other: however often a shape occurs open, each kind keeps HIDDEN times the
weight of other, and words and neighbours speak little against it, so that evidence from the word before or along a skip decides.

Potentials are smoothed counts over all documents: shapes and preceding words by
label, labels by preceding label, agreement along skip edges. Their table is
bounded (SHAPES and CONTEXTS by labels), so it alone visits the driver.

Defined results: a null or empty text has no spans; texts of any length are
searched whole, in linear time; of labels equally likely the first listed
counts; repeated rows (and rows without a doc_id) give a row each; an empty table gives no rows; other columns are ignored by
:func:`find` and kept by :func:`mask`.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
SHAPES = 1024
CONTEXTS = 1024
#: The weight of each possible kind against other that an open token's shape leaves at least.
HIDDEN = 0.08

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_MAILBOX_TAIL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARKED = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
_NUMBER = re.compile(r"\(?[0-9](?:[][ ().-]{0,3}+[0-9])*+")
_WRITTEN = re.compile(r"[\s(\[{]{1,3}at[\s)\]}]{1,3}([A-Za-z0-9-]++(?:(?:\.|[\s(\[{]{1,3}dot[\s)\]}]{1,3})[A-Za-z0-9-]++)++)", re.IGNORECASE)
_DOT = re.compile(r"[\s(\[{]+dot[\s)\]}]+", re.IGNORECASE)
_MASKED = re.compile(r"(?:[*xX#\u2022]{2,}+[ -]?+)++([0-9]{4})\Z")
_DIALLED = re.compile(r"(?:[A-Za-z]+[:=.]?)?\+?[][0-9 ().-]+\Z")
_BEFORE = re.compile(r"([A-Za-z]+)[^A-Za-z0-9]*\Z")
_BOX = re.compile(r"(?<![^\s(\[<,;:'\"])[A-Za-z0-9._%+-]{5,64}+")
_EDGES = "\"'()[]{}<>,;:!?.*$%&#|=/\\`~^"
_MAILBOX = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _MAILBOX:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            yield begin, m.end()
            done = m.end()
        # A run before a later @ never reaches over this one, so each byte is looked at once.
        done = max(done, at + 1)
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, label, end) in code points, by start and then kind as listed."""
    out = []
    if "@" in text:
        out += [(a, 1, b) for a, b in _emails(text)]
    if not _MARKED.search(text):
        return out
    if "." in text:
        for m in _DOTTED.finditer(text):
            if "." not in m[0]:
                continue
            at, parts = m.start(), m[0].split(".")
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                size = sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                    out.append((at, 2, at + size))
                at += size + 1
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 3, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 4, m.end()))
    return sorted(out)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{LABELS[k]}:{a}:{b}" for a, k, b in sorted(spans))


class Node(NamedTuple):
    """A token of the field; label -1 where it is open, ``may`` a bit for each label that it can have."""

    start: int
    label: int
    stop: int
    shape: int
    keys: list[str]
    context: int = -1
    may: int = (1 << len(LABELS)) - 1


def _address(token: str) -> str:
    """A mail address however written, in lower case."""
    if m := _WRITTEN.search(token):
        return f"{token[: m.start()]}@{_DOT.sub('.', m[1])}".lower()
    return token.lower()


def _four(token: str) -> str | None:
    """Four dotted numbers of at most 255, brackets and spaces aside."""
    parts = re.sub(r"[][() ]", "", token).split(".")
    return ".".join(parts) if len(parts) == 4 and all(p.isdecimal() and len(p) <= 3 and int(p) <= 255 for p in parts) else None


def _digits(token: str) -> str:
    return "".join(c for c in token if "0" <= c <= "9")


def _shape(token: str, glued: bool, kind: str) -> int:
    digits = _digits(token)
    letters = sum(c.isalpha() for c in token)
    band = int(np.searchsorted([1, 4, 7, 9, 12, 15, 20], len(digits), "right"))
    check = 12 <= len(digits) <= 19 and _luhn(digits)
    seen = f"{band}|{min(letters, 3)}|{min(token.count('.'), 3)}|{min(token.count('-'), 2)}|{'(' in token}|{' ' in token}|{'@' in token}|{glued}|{check}|{kind}"
    return zlib.crc32(seen.encode()) % SHAPES


def _keys(token: str, label: int, kind: str) -> list[str]:
    """What a token shares with those it may name the same thing as."""
    if kind == "masked":
        return ["f" + _digits(token)]
    if "@" in token or kind == "written":
        whole = _address(token)
        box = whole.partition("@")[0]
        return ["m" + whole, "b" + box] if len(box) >= 5 else ["m" + whole]
    if kind == "box":
        return ["b" + token.lower()]
    digits, out = _digits(token), []
    if label == 2 or _four(token):
        out.append("i" + (_four(token) or token))
    elif len(digits) >= 7:
        out += ["d" + digits, "s" + digits[-7:]]
        if label == 3:
            out.append("f" + digits[-4:])
    return out


def _may(token: str, kind: str) -> int:
    """A bit for each label that an open token can have."""
    if kind in ("written", "box") or "@" in token:
        return 0b00011
    if kind == "masked":
        return 0b01001
    if _four(token):
        return 0b00101
    digits = _digits(token)
    card = 12 <= len(digits) <= 19 and _luhn(digits)
    phone = 7 <= len(digits) <= 15 and token.count(".") < 4 and _DIALLED.match(token)
    return 1 | (8 if card else 0) | (16 if phone else 0)


def _context(text: str, at: int) -> int:
    m = _BEFORE.search(text, max(0, at - 24), at)
    return zlib.crc32(m[1].lower().encode()) % CONTEXTS if m else 0


def nodes(text: str) -> tuple[list[tuple[int, int, int]], list[Node]]:
    """The base spans, and the field's nodes by start."""
    base = base_spans(text)
    if not _MARKED.search(text) and not _WRITTEN.search(text):
        return base, []
    taken = []
    for a, k, b in base:
        if not taken or a >= taken[-1][2]:
            taken.append((a, k, b))
    out = [(a, k, b, "") for a, k, b in taken]
    starts, stops = [a for a, _, _ in taken], [b for _, _, b in taken]

    def free(a: int, b: int) -> bool:
        at = bisect.bisect_right(stops, a)
        return at >= len(starts) or starts[at] >= b

    held = 0
    for m in _WRITTEN.finditer(text):
        a = m.start()
        while a > held and m.start() - a < 64 and text[a - 1] in _MAILBOX:
            a -= 1
        if a < m.start() and free(a, m.end()):
            out.append((a, -1, m.end(), "written"))
            held = m.end()
    out.sort()
    starts, stops = [x[0] for x in out], [x[2] for x in out]
    boxes = {_address(text[a:b]).partition("@")[0] for a, k, b, kind in out if k == 1 or kind == "written"}
    boxes = {x for x in boxes if len(x) >= 5 and not x.isalpha()}
    if boxes:
        for m in _BOX.finditer(text):
            a, b = m.start(), m.end()
            while b > a and text[b - 1] in ".-%+_":
                b -= 1
            if text[a:b].lower() in boxes and not text.startswith("@", b) and free(a, b):
                out.append((a, -1, b, "box"))
    here = {a for a, _, _, kind in out if kind == "box"}
    numbers_until = 0
    for m in _TOKEN.finditer(text):
        a, b = m.start(), m.end()
        while a < b and text[a] in _EDGES:
            a += 1
        while b > a and text[b - 1] in _EDGES:
            b -= 1
        if tail := _MASKED.search(text, max(m.start(), b - 24), b):
            if free(tail.start(), b) and tail.start() >= numbers_until:
                out.append((tail.start(), -1, b, "masked"))
                numbers_until = b
            continue
        token = text[a:b]
        if "@" in token or any(c.isalpha() for c in token):
            if a >= numbers_until and a not in here and free(a, b):
                out.append((a, -1, b, ""))
        elif b > numbers_until:
            for n in _NUMBER.finditer(text, max(a, numbers_until)):
                if n.start() >= b:
                    break
                numbers_until = n.end()
                if free(n.start(), n.end()):
                    out.append((n.start(), -1, n.end(), ""))
    out.sort()
    made = []
    for a, k, b, kind in out:
        token = text[a:b].lstrip("+")
        glued = (a > 0 and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum())
        may = _may(token, kind) if k < 0 else 1 << k
        made.append(Node(a, k, b, _shape(token, glued, kind), _keys(token, k, kind), _context(text, a), may))
    return base, made


def _edges(field: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node pairs and whether each is a skip edge."""
    last: dict[str, int] = {}
    left, right, skip = [], [], []
    for i, keys in enumerate(f[4] for f in field):
        if i:
            left.append(i - 1), right.append(i), skip.append(0)
        seen = set()
        for key in keys:
            j = last.get(key)
            if j is not None and j not in seen:
                seen.add(j)
                left.append(j), right.append(i), skip.append(1)
            last[key] = i
    return np.array(left, np.int64), np.array(right, np.int64), np.array(skip, np.int64)


@dataclass
class Potentials:
    """Log potentials: shape by label, label by label along the chain, and along skips; preceding word by label."""

    shape: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    context: np.ndarray | None = None


def counts(field: list[tuple]) -> list[tuple[str, int, int]]:
    """What a document adds to the tables: (table, row, column) events."""
    labels = [max(f[1], 0) for f in field]
    out = [("shape", f[3], y) for f, y in zip(field, labels, strict=True)]
    out += [("context", f[5], y) for f, y in zip(field, labels, strict=True)]
    left, right, skip = _edges(field)
    for i, j, s in zip(left.tolist(), right.tolist(), skip.tolist(), strict=True):
        if not s:
            out.append(("chain", labels[i], labels[j]))
        elif labels[i] and labels[j]:
            out.append(("skip", 0, int(labels[i] == labels[j])))
    return out


def potentials(rows: list[tuple[str, int, int, int]]) -> Potentials:
    """From summed (table, row, column, count) rows."""
    shape = np.zeros((SHAPES, len(LABELS)))
    chain = np.zeros((len(LABELS), len(LABELS)))
    context = np.zeros((CONTEXTS, len(LABELS)))
    # Seven like digits or one address by chance are rare: skips agree before any are counted.
    agree = np.array([1.0, 256.0])
    for table, i, j, n in rows:
        if table == "shape":
            shape[i, j] += n
        elif table == "chain":
            chain[i, j] += n
        elif table == "context":
            context[i, j] += n
        else:
            agree[j] += n
    prior = np.array([0.9, 0.025, 0.025, 0.025, 0.025])
    by_shape = (shape + 2 * prior) / (shape.sum(1, keepdims=True) + 2)
    by_shape = np.log(np.maximum(by_shape, HIDDEN * by_shape[:, :1]))
    word = np.log((context + prior) / (context.sum(1, keepdims=True) + 1) * (context.sum() + 1) / (context.sum(0) + prior))
    lift = (chain + prior * prior[:, None] * 10) / (chain.sum() + 10)
    lift = np.log(lift / (lift.sum(1, keepdims=True) * lift.sum(0, keepdims=True)))
    weight = float(np.clip(np.log(agree[1] / agree[0]), 1.0, 6.0))
    return Potentials(by_shape, np.clip(lift, -0.5, 1), weight * np.eye(len(LABELS)), np.clip(word, -0.5, 3))


def infer(field: list[tuple], model: Potentials, rounds: int = 30, damping: float = 0.3) -> np.ndarray:
    """Marginals of each node by loopy sum-product with damping."""
    field, k = [Node(*f) for f in field], len(LABELS)
    unary = model.shape[[f.shape for f in field]]
    if model.context is not None:
        unary = unary + model.context[[f.context for f in field]]
    for i, f in enumerate(field):
        may = 1 << f.label if f.label > 0 else f.may
        unary[i, [not may >> y & 1 for y in range(k)]] = -30.0
        if f.label > 0:
            unary[i, f.label] = 0.0
    left, right, skip = _edges(field)
    if not len(left):
        p = np.exp(unary - unary.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)
    pair = np.where(skip[:, None, None] == 1, model.skip[None], model.chain[None])
    source, target = np.concatenate([left, right]), np.concatenate([right, left])
    table = np.exp(np.concatenate([pair, pair.transpose(0, 2, 1)]))
    m = len(left)
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    message = np.zeros((2 * m, k))
    for _ in range(rounds):
        belief = unary.copy()
        np.add.at(belief, target, message)
        sent = belief[source] - message[back]
        sent -= sent.max(1, keepdims=True)
        new = np.log(np.einsum("ek,ekl->el", np.exp(sent), table) + 1e-300)
        new -= new.max(1, keepdims=True)
        step = (1 - damping) * (new - message)
        message = message + step
        if np.abs(step).max() < 1e-4:
            break
    belief = unary.copy()
    np.add.at(belief, target, message)
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def added_spans(field: list[tuple], model: Potentials) -> list[tuple[int, int, int]]:
    """Spans of open nodes whose likeliest label is a kind, by at least one half."""
    if not any(f[1] < 0 for f in field):
        return []
    p = infer(field, model)
    best = p.argmax(1)
    return [(f[0], int(y), f[2]) for f, y, q in zip(field, best, p.max(1), strict=True) if f[1] < 0 and y and q >= 0.5]


_FIELD = "array<struct<start:int,label:int,stop:int,shape:int,keys:array<string>,context:int,may:int>>"
_FIELD_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("label", pa.int32()), ("stop", pa.int32()), ("shape", pa.int32()), ("keys", pa.list_(pa.string())), ("context", pa.int32()), ("may", pa.int32())]))


def recognise(docs: DataFrame) -> DataFrame:
    """Base spans and the field's nodes of every row: doc_id, n_*, base, nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, spans, fields = [[] for _ in KINDS], [], []
            for text in batch.column(1).to_pylist():
                base, field = nodes(text or "")
                for j, out in enumerate(n):
                    out.append(sum(k == j + 1 for _, k, _ in base))
                spans.append(written(base))
                fields.append([f._asdict() for f in field])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in n), pa.array(spans, pa.string()), pa.array(fields, _FIELD_ARROW)], ["doc_id", *(f"n_{k}" for k in KINDS), "base", "nodes"])

    storage.small_batches(docs.sparkSession, 256)
    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, f"doc_id long, {', '.join(f'n_{k} long' for k in KINDS)}, base string, nodes {_FIELD}")


def fit(found: DataFrame) -> Potentials:
    """Potentials from the nodes of all documents, counted in tasks and summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[tuple, int] = {}
        for batch in batches:
            for field in batch.column(0).to_pylist():
                for event in counts([Node(**x) for x in field]):
                    table[event] = table.get(event, 0) + 1
        rows = [(*event, n) for event, n in table.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int64()))], ["t", "i", "j", "n"])

    summed = found.where(F.size("nodes") > 0).select("nodes").mapInArrow(run, "t string, i int, j int, n long").groupBy("t", "i", "j").agg(F.sum("n").alias("n"))
    return potentials([tuple(r) for r in summed.collect()])


def find(docs: DataFrame) -> DataFrame:
    """Every row's base and added spans: doc_id, n_*, base_sha256, spans, n_added and n_spans (both together)."""
    found = storage.materialize(recognise(docs), "nodes")
    model = fit(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, added, all_ = [], [], []
            for base, field in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                new = added_spans([Node(**x) for x in field], model) if field else []
                old = [(int(a), LABELS.index(k), int(b)) for k, a, b in (x.split(":") for x in base.split(","))] if base else []
                spans.append(written([*old, *new]))
                added.append(len(new))
                all_.append(len(old) + len(new))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3, 8)), pa.array([hashlib.sha256(b.encode()).hexdigest() for b in batch.column(1).to_pylist()], pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64()), pa.array(all_, pa.int64())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans"])

    names = [f"n_{k}" for k in KINDS]
    ordered = found.select(F.lit(0).alias("_"), "base", "nodes", "doc_id", *names)
    return ordered.mapInArrow(run, f"doc_id long, {', '.join(f'{k} long' for k in names)}, base_sha256 string, spans string, n_added long, n_spans long")


def masked_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span replaced by its kind in brackets; overlapping spans as one."""
    out, at = [], 0
    for a, k, b in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{LABELS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, *, text: str = "text", length: str = "n_chars") -> DataFrame:
    """The same rows and columns with personal data masked; ``length`` follows the text."""
    model = fit(storage.materialize(recognise(docs.select("doc_id", F.col(text).alias("text"))), "nodes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            new = []
            for t in batch.column(at).to_pylist():
                if t:
                    base, field = nodes(t)
                    if base or field:
                        t = masked_text(t, [*base, *added_spans(field, model)])
                new.append(t)
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    storage.small_batches(docs.sparkSession, 256)
    out = docs.mapInArrow(run, docs.schema)
    if length in docs.columns:
        kind = docs.schema[length].dataType
        out = out.withColumn(length, F.when(F.col(text).isNull(), F.col(length)).otherwise(F.length(text)).cast(kind))
    return out
