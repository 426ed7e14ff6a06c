"""Token ids of whole texts by a public tokenizer's vocabulary file."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Words that normalising only lower-cases: printable ASCII and the letters of Latin-1.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: How the vocabulary file cuts a word, for such words.
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
_made: dict[tuple[str, int], WordEncoder] = {}


class _Words(dict):
    """The ids of words in two generations: when the younger is full it becomes the older one,
    so frequent words stay and memory is bounded by ``most`` words."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.half, self.older = make, max(1, most // 2), {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.make(word)
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids


class WordEncoder:
    """``Tokenizer.encode(text, add_special_tokens=False)`` with a bounded memory of words.

    The tokenizer's normaliser and pre-tokeniser never join what white space
    separates, so a text's ids are its words' ids in a row. Texts that hold an
    added token or a separator which only Python counts as white space go to
    the tokenizer as they are.
    """

    def __init__(self, path: str, remember: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        # Letters as the vocabulary writes their bytes, asked of the tokenizer itself.
        letters = [chr(c) for c in range(0xDF, 0x100) if chr(c).isalpha()]
        self.written = str.maketrans({c: self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters}) if self.tokenizer.pre_tokenizer else {}
        probe = ["Qzxv", "a", "bcd.", "the,", "Élève,", "ÀÖØßÿ", "it's", "a1b22", "x$$$", "_-", "l'été"]
        self.plain = all(self._fast(w) == self._whole(w) for w in probe)
        self.known = _Words(self._one, remember)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _fast(self, word: str) -> bytes | None:
        if not _PLAIN.fullmatch(word):
            return None
        low = word.lower()
        if not low.isascii():
            return self._ids([t.id for p in _PIECES.findall(low) for t in self.model.tokenize(p.translate(self.written))])
        if low.isalpha():
            return self._ids([t.id for t in self.model.tokenize(low)])
        return self._ids([t.id for p in _PIECES.findall(low) for t in self.model.tokenize(p)])

    @staticmethod
    def _ids(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def _one(self, word: str) -> bytes:
        if not self.plain:
            return self._whole(word)
        # A capital or a mark at the end of a known word costs no tokenizing.
        low = word.lower()
        if (ids := self.known.get(low)) is not None and word.isascii():
            return ids
        if word[-1] in ".," and word[-2:-1].isalpha() and (ids := self.known.get(low[:-1])) is not None and word.isascii():
            return ids + self.known[word[-1]]
        ids = self._fast(word)
        return self._whole(word) if ids is None else ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if (self.added and self.added.search(text)) or _ODD_SPACE.search(text):
            return self._whole(text)
        known = self.known
        return b"".join([known[w] for w in text.split()])


def encoder(path: str, remember: int = 400_000) -> WordEncoder:
    """One encoder a worker process; later tasks of the process go on with it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = (path, remember)
    if key not in _made:
        _made[key] = WordEncoder(path, remember)
    return _made[key]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
