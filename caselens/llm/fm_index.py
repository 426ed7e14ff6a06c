"""Spelling variants by bidirectional FM-index search schemes (operator 12).

Words are counted over whole texts first, with map-side sums, so a frequent word
is one row from then on. Two words one edit apart agree in either half of
whichever of them asks: the edit lies in the other half. Every word therefore
asks under two keys, its first half and its last, and is posted as data under the
halves that words shorter by one, as long, or longer by one would ask for. Keys
are dealt by hash into blocks of about BLOCK postings; a key of more than HOT
postings is cut into HOT-sized parts of both sides, each pair of parts a block of
its own, so no block grows with a key.

A block's task builds one bidirectional FM-index over its delimited vocabulary:
the suffix orders of the text and of the reversed text, with counts of smaller
symbols before each rank. A search state is a pair of suffix-rank intervals that
are extended to either side in step. All words of a length search together: the
exact half is matched towards the far delimiter, then the state goes across the
other half; at every place it may spend its one error on another symbol, a
further one, or on skipping one; where the near delimiter ends the match, the
interval is one word. Pairs met in several blocks count once.

Defined results: null or empty texts hold no words; a null doc_id hashes as the
empty text; repeated rows count as often as they come; ties of n go to the word
smaller in code-point order; an empty table, or one without words often enough,
gives no rows; extra columns are ignored. Texts are read whole, whatever their
length; words have no greatest length.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage

LEAST_CHARS = 6
LEAST_COUNT = 5
RATIO = 5
ERASE_ONE_IN = 199
BLOCK = 8192
HOT = 4096
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class State(NamedTuple):
    """Ranks of a pattern's matches among suffixes (from low) and among reversed prefixes (from back), for every search."""

    asks: np.ndarray
    low: np.ndarray
    back: np.ndarray
    size: np.ndarray

    def of(self, rows: np.ndarray) -> State:
        return State(*(x[rows] for x in self))

    @staticmethod
    def joined(*states: State) -> State:
        return State(*(np.concatenate(x) for x in zip(*states, strict=True)))


def _order(text: np.ndarray, symbols: int) -> np.ndarray:
    """Ranks' positions in the order of the rotations of ``text``, by doubling from packed symbols."""
    bits = max(1, symbols.bit_length())
    width = 60 // bits
    rank = np.zeros(len(text), np.int64)
    for k in range(width):
        rank = (rank << bits) | np.roll(text, -k)
    while True:
        values, rank = np.unique(rank, return_inverse=True)
        if len(values) == len(text) or width > len(text):
            return np.argsort(rank, kind="stable")
        rank = rank * len(values) + np.roll(rank, -width)
        width *= 2


class Index:
    """A bidirectional FM-index over distinct words."""

    def __init__(self, words: list[str]):
        self.words = words
        points = np.frombuffer("\0".join(["", *words, ""]).encode("utf-32-le"), np.uint32)
        self.alphabet = np.unique(points)
        text = np.searchsorted(self.alphabet, points)
        # The last symbol stands for those of asking words that no word here has.
        self.symbols = len(self.alphabet) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.symbols))])
        ranks = _order(text, self.symbols)
        self.word_at = np.cumsum(text == 0)[ranks] - 1
        self.smaller = self._counts(text, ranks)
        reverse = text[::-1]
        self.smaller_back = self._counts(reverse, _order(reverse, self.symbols))

    def _counts(self, text: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """Of every symbol and rank: how many smaller symbols precede the suffixes of lower ranks."""
        before = text[ranks - 1]
        out = np.zeros((self.symbols + 1, len(text) + 1), np.int32)
        for s in range(1, self.symbols + 1):
            np.cumsum(before < s, out=out[s, 1:])
        return out

    def codes(self, words: list[str]) -> np.ndarray:
        """Symbols of words of one length, a row each."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)
        at = np.searchsorted(self.alphabet, points)
        return np.where(self.alphabet[np.minimum(at, self.symbols - 2)] == points, at, self.symbols - 1)

    def everything(self, n: int) -> State:
        zero = np.zeros(n, np.int64)
        return State(np.arange(n), zero, zero, np.full(n, self.smaller.shape[1] - 1))

    def extend(self, state: State, symbol: np.ndarray | int, right: bool) -> State:
        """The states with ``symbol`` put to one side; those without matches end."""
        start = state.back if right else state.low
        table = self.smaller_back if right else self.smaller
        stop = start + state.size
        lower, upper = table[symbol, start], table[symbol, stop]
        before = table[np.asarray(symbol) + 1, start] - lower
        size = table[np.asarray(symbol) + 1, stop] - upper - before
        start = self.first[symbol] + before
        other = (state.low if right else state.back) + upper - lower
        out = State(state.asks, other, start, size) if right else State(state.asks, start, other, size)
        return out.of(size > 0)

    def extend_other(self, state: State, symbol: np.ndarray, right: bool) -> State:
        """The states with every symbol but the delimiter and their own ``symbol`` put to one side."""
        rest = np.arange(1, self.symbols - 1)
        every, all_symbols = np.repeat(np.arange(len(state.asks)), len(rest)), np.tile(rest, len(state.asks))
        differs = all_symbols != symbol[every]
        return self.extend(state.of(every[differs]), all_symbols[differs], right)

    def one_error(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of words of one length: (place in ``words``, number of an indexed word one edit away), each once."""
        codes = self.codes(words)
        n = codes.shape[1]
        half = n // 2
        found = []
        # The first half is matched leftwards to its delimiter and the error sought to its right; then the other way round.
        for right, exact, across in ((True, range(half - 1, -1, -1), range(half, n)), (False, range(half, n), range(half - 1, -1, -1))):
            state = self.everything(len(words))
            for j in exact:
                state = self.extend(state, codes[state.asks, j], not right)
            state = self.extend(state, 0, not right)
            wrong = state.of(np.zeros(0, np.int64))
            for j in across:
                other = self.extend_other(state, codes[state.asks, j], right)
                longer = State.joined(wrong, other)
                wrong = State.joined(self.extend(longer, codes[longer.asks, j], right), other, state)
                state = self.extend(state, codes[state.asks, j], right)
            wrong = State.joined(wrong, self.extend_other(state, np.zeros(len(state.asks), np.int64), right))
            found.append(self.extend(wrong, 0, right))
        asks, low, _, _ = State.joined(*found)
        pairs = np.unique(asks * len(self.words) + self.word_at[low])
        return pairs // len(self.words), pairs % len(self.words)


def near_pairs(data: list[str], asking: list[str]) -> Iterator[tuple[list[int], list[int]]]:
    """Places of asking words and of the distinct ``data`` words one edit away from them, by length of asking words."""
    if not data:
        return
    index = Index(data)
    length = np.array([len(w) for w in asking])
    for n in np.unique(length):
        rows = np.flatnonzero(length == n)
        for part in np.array_split(rows, -(-len(rows) // 2048)):
            a, b = index.one_error([asking[i] for i in part])
            yield part[a].tolist(), b.tolist()


def vocabulary(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, one_in: int = ERASE_ONE_IN) -> DataFrame:
    """word and n of every word that is long and frequent enough."""
    # A run that is too short stays so without a code point: only longer ones are taken, and these are maximal.
    runs = F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-zÀ-ÿ]{{{least_chars},}}"), F.lit(0)))
    low = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), runs.alias("run")).select("id", F.translate("run", _UPPER, _UPPER.lower()).alias("run"))
    hashed = low.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    erased = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % one_in == 0, erased).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _halves(lengths: list[Column]) -> Column:
    """Keys of a word's first and last halves, were it of each of ``lengths``."""
    word = F.col("word")
    starts = [F.concat(F.lit("<"), F.substring(word, F.lit(1), (n / 2).cast("int"))) for n in lengths]
    ends = [F.concat(F.lit(">"), F.substring(word, F.length(word) - (n - (n / 2).cast("int")) + 1, F.length(word))) for n in lengths]
    return F.array_distinct(F.array(*starts, *ends))


def pairs_one_edit_apart(words: DataFrame, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """(word, near, near_n) of all pairs of the distinct words of ``words`` (word, n) one edit apart, both ways."""
    n = F.length("word")
    data = words.select("word", "n", F.explode(_halves([n - 1, n, n + 1])).alias("key"))
    asking = words.select("word", F.lit(None).cast("long").alias("n"), F.explode(_halves([n])).alias("key"))
    common = data.groupBy("key").agg(F.count("*").alias("postings")).where(F.col("postings") > hot).select("key", F.ceil(F.col("postings") / hot).cast("int").alias("parts"))
    common = storage.materialize(common, "common")
    blocks = max(1, -(-5 * words.count() // block))

    def dealt(rows: DataFrame, is_data: bool) -> DataFrame:
        parts = F.coalesce("parts", F.lit(1))
        own = F.pmod(F.xxhash64("word"), parts)
        with_parts = rows.join(common, "key", "left").select("word", "n", "key", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
        pair = ("own", "other") if is_data else ("other", "own")
        return with_parts.select("word", "n", F.pmod(F.xxhash64("key", *(F.col(p).cast("long") for p in pair)), F.lit(blocks)).alias("block"))

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        is_data = frame["n"].notna()
        known = frame[is_data].drop_duplicates("word").sort_values("word")
        names, counts = known["word"].tolist(), known["n"].astype("int64").to_numpy()
        asks = frame.loc[~is_data, "word"].drop_duplicates().tolist()
        out = [(asks[i], names[j], int(counts[j])) for a, b in near_pairs(names, asks) for i, j in zip(a, b, strict=True)]
        return pd.DataFrame(out, columns=["word", "near", "near_n"])

    met = dealt(data, True).unionAll(dealt(asking, False)).groupBy("block").applyInPandas(search, "word string, near string, near_n long")
    return met.distinct()


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) from (word, form): pointers are doubled until none leads to a word that has a form. Counts grow by RATIO a step, so chains are short."""
    now = storage.materialize(links.select("word", F.col("form").alias("root")), "roots")
    while not now.join(now.select(F.col("word").alias("root")), "root", "left_semi").isEmpty():
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = storage.materialize(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        storage.release(now)
        now = after
    return now


def variants(docs: DataFrame, *, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, ratio: int = RATIO, one_in: int = ERASE_ONE_IN, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the vocabulary."""
    words = storage.materialize(vocabulary(docs, least_chars, least_count, one_in), "words")
    pairs = pairs_one_edit_apart(words, block, hot)
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    joined = words.join(best, "word", "left")
    is_form = -F.col("best.less") >= ratio * F.col("n")
    known = storage.materialize(joined.select("word", F.when(is_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, -F.col("best.less")).alias("form_n")), "forms")
    roots = _roots(known.where("form IS NOT NULL"))
    storage.release(words)
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
