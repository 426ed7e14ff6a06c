"""Main text of web pages by a recurrent block labeller (operator 13).

A page is a sequence of leaf blocks (see html_leaves). A block enters as the sum
of its tag path's vectors (elements, class and id names, hashed), the mean of its
hashed words' vectors and a few measures (length, links, sentence marks); a
bidirectional LSTM in numpy reads the whole page's sequence, so each block's label
depends on all of the document, and the blocks labelled as the article are joined.

The labeller is trained when the query starts, in one task, on at most SAMPLE pages of the
table, taken by hash: on those that mark their article themselves (one outermost
<article> or <main>; what stands in it but not in a menu, form, advert and so
forth is text) and on LAYOUTS pages of random layouts whose parts are known,
filled with the sampled pages' words (block_templates). Every page is then labelled; no page is read in part. Training has fixed seeds and a
fixed number of steps, so its cost doesn't grow with the table.

Defined results: null or empty html, and pages without a block labelled as text,
give an empty text; white space is Unicode's, after references are decoded; <br>
is white space; rows with a null id or repeated rows get a row each; pages of any
length are labelled whole; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops, storage
from .block_templates import MARK, Templates
from .html_leaves import PATH_BUCKETS, Leaf, leaves

SAMPLE = 256
LAYOUTS = 1024
ROUNDS = 160
PAGES_A_ROUND = 24
WORD_BUCKETS = 2048
_PATH, _WORD, _HIDDEN = 16, 12, 24
_MEASURES = 7
_INPUT = _PATH + _WORD + _MEASURES
#: Blocks in a row that the training reads together.
_STRETCH = 128
#: Blocks that are labelled together.
_CHUNK = 1 << 15

# Parts within an article element that aren't its text.
_NOT_TEXT = ("nav", "form", "footer", "aside", "menu", "button", "select", "dialog")


@dataclass
class Blocks:
    """Inputs of all blocks of some pages, one after the other; ``pages`` are the pages' offsets."""

    pages: np.ndarray
    path: np.ndarray
    path_at: np.ndarray
    word: np.ndarray
    word_at: np.ndarray
    measures: np.ndarray


def inputs(pages: list[list[Leaf]]) -> Blocks:
    flat = [leaf for page in pages for leaf in page]
    buf, offs = bytesops.text_bytes(pa.array([leaf.text for leaf in flat], pa.string()))
    hashed, first = bytesops.word_hashes(buf, offs)
    size, n_words = np.diff(offs), np.diff(first)
    marks = np.concatenate([[0], np.cumsum((buf == 46) | (buf == 44) | (buf == 63) | (buf == 33))])
    ends = buf[offs[1:] - 1] if len(flat) else np.zeros(0, np.uint8)
    place = np.concatenate([np.arange(len(p)) for p in pages] or [np.zeros(0)])
    ahead = np.concatenate([np.arange(len(p))[::-1] for p in pages] or [np.zeros(0)])
    measures = np.stack([
        np.log1p(n_words) / 4, np.log1p(size) / 6, np.array([leaf.linked for leaf in flat]), np.minimum(np.diff(marks[offs]) / np.maximum(n_words, 1), 1),
        ((ends == 46) | (ends == 33) | (ends == 63)).astype(float), 1 / (1 + place), 1 / (1 + ahead),
    ], 1).astype(np.float32)
    lengths = np.array([len(leaf.path) for leaf in flat], np.int64)
    path = np.fromiter((i for leaf in flat for i in leaf.path), np.int64, int(lengths.sum()))
    word = (hashed % np.uint64(WORD_BUCKETS)).astype(np.int64)
    return Blocks(np.concatenate([[0], np.cumsum([len(p) for p in pages])]).astype(np.int64), path, np.concatenate([[0], np.cumsum(lengths)]), word, first, measures)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts[:-1], axis=0) if len(starts) > 1 else np.zeros((0, values.shape[1]), values.dtype)


def _gathered(values: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` by bucket."""
    out = np.zeros((n, values.shape[1]), np.float32)
    order = np.argsort(bucket, kind="stable")
    used, first = np.unique(bucket[order], return_index=True)
    out[used] = np.add.reduceat(values[order], first, axis=0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Hashed embeddings, a bidirectional LSTM and a logistic output over both directions' states."""

    def __init__(self, seed: int = 13):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, by: rng.normal(0, by, shape).astype(np.float32)
        self.w = {"path": draw(PATH_BUCKETS, _PATH, by=0.2), "word": draw(WORD_BUCKETS, _WORD, by=0.2), "out": draw(2 * _HIDDEN, 1, by=0.2), "out0": np.zeros(1, np.float32)}
        for way in "lr":
            self.w[f"in_{way}"] = draw(_INPUT, 4 * _HIDDEN, by=_INPUT**-0.5)
            self.w[f"back_{way}"] = draw(_HIDDEN, 4 * _HIDDEN, by=_HIDDEN**-0.5)
            self.w[f"bias_{way}"] = np.concatenate([np.zeros(_HIDDEN), np.ones(_HIDDEN), np.zeros(2 * _HIDDEN)]).astype(np.float32)

    def _vectors(self, b: Blocks, keep_words: np.ndarray | None = None) -> np.ndarray:
        path = _sums(self.w["path"][b.path], b.path_at) / np.sqrt(np.maximum(np.diff(b.path_at), 1))[:, None]
        word = _sums(self.w["word"][b.word], b.word_at) / np.maximum(np.diff(b.word_at), 1)[:, None]
        if keep_words is not None:
            word *= keep_words[:, None]
        return np.hstack([path, word, b.measures]).astype(np.float32)

    @staticmethod
    def _steps(b: Blocks, right: bool) -> tuple[list[np.ndarray], np.ndarray]:
        """Blocks of each step, of the longest page first, and the pages' order."""
        length = np.diff(b.pages)
        order = np.argsort(-length, kind="stable")
        begin, length = (b.pages[1:][order] - 1 if right else b.pages[:-1][order]), length[order]
        alive = len(length) - np.searchsorted(length[::-1], np.arange(length[0] if len(length) else 0), "right")
        return [begin[:n] + (-t if right else t) for t, n in enumerate(alive)], order

    def _read(self, x: np.ndarray, b: Blocks, way: str, keep: list | None = None) -> np.ndarray:
        """The states of one direction over all blocks; what a backward pass needs goes to ``keep``."""
        z = x @ self.w[f"in_{way}"] + self.w[f"bias_{way}"]
        back, k = self.w[f"back_{way}"], _HIDDEN
        out = np.zeros((len(x), k), np.float32)
        h = c = np.zeros((0, k), np.float32)
        for t, rows in enumerate(self._steps(b, way == "r")[0]):
            g = z[rows]
            if t:
                h, c = h[: len(rows)], c[: len(rows)]
                g = g + h @ back
            else:
                h = c = np.zeros((len(rows), k), np.float32)
            gates, u = _sigmoid(g[:, : 3 * k]), np.tanh(g[:, 3 * k :])
            i, f, o = gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :]
            after = f * c + i * u
            bent = np.tanh(after)
            if keep is not None:
                keep.append((rows, h, c, i, f, o, u, bent))
            h, c = o * bent, after
            out[rows] = h
        return out

    def chances(self, b: Blocks) -> np.ndarray:
        """Each block's chance to be text of the article."""
        if not len(b.measures):
            return np.zeros(0)
        x = self._vectors(b)
        states = np.hstack([self._read(x, b, way) for way in "lr"])
        return _sigmoid(states @ self.w["out"] + self.w["out0"])[:, 0]

    def gradients(self, b: Blocks, labels: np.ndarray, keep_words: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Mean log loss over the blocks and its gradient by every weight."""
        w, k = self.w, _HIDDEN
        x = self._vectors(b, keep_words)
        kept: dict[str, list] = {"l": [], "r": []}
        states = np.hstack([self._read(x, b, way, kept[way]) for way in "lr"])
        p = _sigmoid(states @ w["out"] + w["out0"])[:, 0]
        loss = -float(np.mean(np.where(labels > 0, np.log(p + 1e-9), np.log(1 - p + 1e-9))))
        error = ((p - labels) / len(labels)).astype(np.float32)[:, None]
        grad = {"out": states.T @ error, "out0": error.sum(0)}
        along = error @ w["out"].T
        dx = np.zeros_like(x)
        for way, part in (("l", along[:, :k]), ("r", along[:, k:])):
            dz, back = np.zeros((len(x), 4 * k), np.float32), w[f"back_{way}"]
            d_back = np.zeros_like(back)
            dh = dc = np.zeros((0, k), np.float32)
            for rows, h, c, i, f, o, u, bent in reversed(kept[way]):
                more = np.zeros((len(rows) - len(dh), k), np.float32)
                dh, dc = np.vstack([dh, more]) + part[rows], np.vstack([dc, more])
                dc = dc + dh * o * (1 - bent**2)
                g = np.hstack([dc * u * i * (1 - i), dc * c * f * (1 - f), dh * bent * o * (1 - o), dc * i * (1 - u**2)])
                dz[rows] = g
                d_back += h.T @ g
                dh, dc = g @ back.T, dc * f
            grad[f"back_{way}"], grad[f"in_{way}"], grad[f"bias_{way}"] = d_back, x.T @ dz, dz.sum(0)
            dx += dz @ w[f"in_{way}"].T
        n_path, n_word = np.diff(b.path_at), np.diff(b.word_at)
        grad["path"] = _gathered(np.repeat(dx[:, :_PATH] / np.sqrt(np.maximum(n_path, 1))[:, None], n_path, axis=0), b.path, PATH_BUCKETS)
        d_word = dx[:, _PATH : _PATH + _WORD] / np.maximum(n_word, 1)[:, None] * (1 if keep_words is None else keep_words[:, None])
        grad["word"] = _gathered(np.repeat(d_word, n_word, axis=0), b.word, WORD_BUCKETS)
        return loss, grad

    def train(self, batches: Iterator[tuple[Blocks, np.ndarray]], rounds: int, rate: float = 0.01, seed: int = 5) -> Labeller:
        """Adam over the batches, with words left out of a third of the blocks."""
        rng = np.random.default_rng(seed)
        first, second = ({n: np.zeros_like(v) for n, v in self.w.items()} for _ in range(2))
        for t, (b, labels) in enumerate(batches, 1):
            _, grad = self.gradients(b, labels, (rng.random(len(labels)) > 1 / 3).astype(np.float32))
            norm = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
            for name, g in grad.items():
                g = g / max(1.0, norm)
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.99 * second[name] + 0.01 * g**2
                step = rate * min(1.0, 2 * (1 - t / (rounds + 1)))
                self.w[name] -= step * (first[name] / (1 - 0.9**t)) / (np.sqrt(second[name] / (1 - 0.99**t)) + 1e-6)
        return self


def marked(page: str) -> tuple[list[Leaf], np.ndarray]:
    """Blocks of a page whose text blocks are marked, without the marks, and their labels."""
    found = leaves(page)
    labels = np.array([leaf.text.startswith(MARK) for leaf in found], np.float32)
    return [leaf._replace(text=leaf.text.replace(MARK, "") or "-") for leaf in found], labels


def self_labelled(found: list[Leaf]) -> np.ndarray | None:
    """Labels of a page that has blocks within and without an article (or main) element; None for others."""
    bucket = lambda name: zlib.crc32(f"in {name}".encode()) % PATH_BUCKETS
    for name in ("article", "main"):
        inside = np.array([bucket(name) in leaf.path for leaf in found], bool)
        if inside.any() and not inside.all():
            odd = [bucket(n) for n in _NOT_TEXT]
            return (inside & ~np.array([any(o in leaf.path for o in odd) for leaf in found])).astype(np.float32)
    return None


def fit(sample: list[str], *, layouts: int = LAYOUTS, rounds: int = ROUNDS, seed: int = 13) -> Labeller:
    """A labeller trained on sampled pages and on random layouts with their words."""
    rng = np.random.default_rng(seed)
    read = [leaves(page) for page in sample]
    known = [(found, labels) for found in read if found and (labels := self_labelled(found)) is not None]
    words = sorted({w for found in read for leaf in found for w in leaf.text.split()})
    templates = Templates(rng, [w.replace("&", "&amp;").replace("<", "&lt;") for w in words])
    made = [marked(templates.page()) for _ in range(layouts)]

    def stretch(found: list[Leaf], labels: np.ndarray) -> tuple[list[Leaf], np.ndarray]:
        """A long page teaches by a stretch at a time, so that a round's work is bounded."""
        last = len(found) - _STRETCH
        at = int(rng.choice([0, last, rng.integers(last + 1)]))
        return found[at : at + _STRETCH], labels[at : at + _STRETCH]

    def batches() -> Iterator[tuple[Blocks, np.ndarray]]:
        for _ in range(rounds):
            take = rng.integers(len(known), size=PAGES_A_ROUND // 4) if known else []
            pages = [known[i] if len(known[i][0]) <= _STRETCH else stretch(*known[i]) for i in take] + [made[i] for i in rng.integers(layouts, size=PAGES_A_ROUND - len(take))]
            yield inputs([p for p, _ in pages]), np.concatenate([labels for _, labels in pages])

    return Labeller(seed).train(batches(), rounds)


def sampled(pages: DataFrame, at_most: int = SAMPLE) -> DataFrame:
    """At most ``at_most`` pages, those whose ids hash lowest; a first cut by the hash keeps what is ranked small in any table."""
    hashed = pages.where("html IS NOT NULL").select("html", F.crc32(F.coalesce(F.col("page_id").cast("string"), F.lit(""))).alias("h"))
    share = 8 * at_most / max(1, pages.count())
    few = hashed if share >= 1 else hashed.where(F.col("h") < int(share * 2**32))
    return few.orderBy("h", F.xxhash64("html")).limit(at_most).select("html")


def trained(pages: DataFrame, *, sample: int = SAMPLE, layouts: int = LAYOUTS, rounds: int = ROUNDS) -> Labeller:
    """A labeller fitted in one task on the sampled pages; its weights, some 180 KB, are all that comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [page for batch in batches for page in batch.column(0).to_pylist()]
        weights = fit(read, layouts=layouts, rounds=rounds).w
        yield pa.RecordBatch.from_arrays([pa.array(list(weights)), pa.array([w.astype(np.float32).tobytes() for w in weights.values()])], ["name", "weights"])

    out = Labeller()
    for r in sampled(pages, sample).coalesce(1).mapInArrow(run, "name string, weights binary").collect():
        out.w[r.name] = np.frombuffer(r.weights, np.float32).reshape(out.w[r.name].shape)
    return out


def main_texts(labeller: Labeller, column: list[str | None]) -> list[str]:
    """The article's text of every page."""
    out: list[str] = []
    held: list[list[Leaf]] = []

    def label() -> None:
        chance = labeller.chances(b := inputs(held))
        for page, first in zip(held, b.pages[:-1], strict=True):
            out.append("\n".join(leaf.text for leaf, c in zip(page, chance[first : first + len(page)], strict=True) if c >= 0.5))
        held.clear()

    n = 0
    for html in column:
        held.append(leaves(html))
        n += len(held[-1])
        if n >= _CHUNK:
            label()
            n = 0
    label()
    return out


def extract(pages: DataFrame, *, sample: int = SAMPLE, layouts: int = LAYOUTS, rounds: int = ROUNDS) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    storage.small_batches(pages.sparkSession, 256)
    labeller = trained(pages, sample=sample, layouts=layouts, rounds=rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = main_texts(labeller, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kept = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    schema = f"page_id {kept.schema['page_id'].dataType.simpleString()}, url string, text string"
    return kept.mapInArrow(run, schema).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
